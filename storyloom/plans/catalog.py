"""Named queries over the sample tables, with SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import speech
from ..functions import text as T
from ..functions.vectors import doubles
from ..operators import batching, density, entities, index, intervals, scenes, search, signals, transcript, vectors
from ..operators.written import folder_of
from ..sources import books, caches, speakers
from . import snapshots

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str = ""):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", doubles(F.col("embedding")).alias("v"))


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as intervals of a user: half an hour and more by value."""
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), start.alias("start"), (start + 1800 + F.col("event_id") % 7200).alias("end"), F.col("event_type").alias("label"))


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").alias("chapter"), F.col("turn").alias("scene"), F.lower(F.regexp_extract("text", "([A-Za-z]+)", 1)).alias("alias"))


HOUR = 3600.0
E = "WITH e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS raw FROM embeddings), u AS (SELECT id, label, raw, list_transform(raw, lambda x: x / greatest(sqrt(list_inner_product(raw, raw)), 1e-10)) AS v FROM e)"
C = E + ", c AS (SELECT label, list(x ORDER BY i) AS centroid FROM (SELECT label, i, avg(v[i]) AS x FROM u, range(1, 65) r(i) GROUP BY label, i) GROUP BY label)"
I = "WITH t AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + 1800 + event_id % 7200 AS e, event_type AS label FROM events)"
O = "WITH o AS (SELECT conv_id AS chapter, turn AS scene, lower(regexp_extract(text, '([A-Za-z]+)', 1)) AS alias FROM conversations)"


@query(E + " SELECT label, i::INT AS i, round(avg(v[i]), 6) AS x FROM u, range(1, 65) r(i) GROUP BY label, i")
def centroid_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.centroids(vectors.unit(embeddings(spark, sf_dir)))
    return rows.select("label", F.posexplode("centroid").alias("i", "x")).select("label", (F.col("i") + 1).alias("i"), F.round("x", 6).alias("x"))


@query(C + """, s AS (SELECT u.id, u.label, c.label AS other, round(list_inner_product(u.v, c.centroid) / (greatest(sqrt(list_inner_product(u.v, u.v)), 1e-10) * greatest(sqrt(list_inner_product(c.centroid, c.centroid)), 1e-10)), 9) AS sim FROM u, c),
    b AS (SELECT id, label, arg_max(other, (sim, -other)) AS speaker, max(sim) AS sim FROM s GROUP BY id, label),
    g AS (SELECT label AS utterance, speaker, round(sum(sim), 9) AS total, count(*) AS n, min(id) AS first, avg(sim) AS mean FROM b GROUP BY ALL),
    r AS (SELECT *, sum(n) OVER (PARTITION BY utterance) AS votes, row_number() OVER (PARTITION BY utterance ORDER BY total DESC, first) AS rank FROM g)
    SELECT utterance, speaker, round(total, 6) AS total, round(mean, 6) AS mean, votes::BIGINT AS votes, votes >= 2 AS enrolled FROM r WHERE rank = 1""")  # fmt: skip
def speaker_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.unit(embeddings(spark, sf_dir))
    near = vectors.nearest_centroid(rows, vectors.centroids(rows))
    votes = near.select(F.col("label").alias("utterance"), F.col("id").alias("pos"), F.col("best").alias("speaker"), "sim")
    return vectors.weighted_vote(votes, "utterance").withColumn("total", F.round("total", 6))


@query(E + ", p AS (SELECT a.label, a.id, round(avg(list_inner_product(a.v, b.v)), 9) AS m FROM u a JOIN u b USING (label) GROUP BY a.label, a.id) SELECT label, arg_max(id, (m, -id)) AS medoid FROM p GROUP BY label")
def medoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.medoids(embeddings(spark, sf_dir))


@query(E + ", p AS (SELECT a.label, a.id, avg(list_inner_product(a.v, b.v)) FILTER (WHERE a.id <> b.id) AS m FROM u a JOIN u b USING (label) GROUP BY a.label, a.id) SELECT label, round(coalesce(max(m), 1.0), 6) AS coherence FROM p GROUP BY label")
def coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.coherence(embeddings(spark, sf_dir)).withColumn("coherence", F.round("coherence", 6))


@query(E + ", n AS (SELECT a.id, a.label, arg_max(b.label, (round(list_inner_product(a.v, b.v), 9), -b.id)) AS other FROM u a JOIN u b ON a.id <> b.id WHERE a.label <> -1 GROUP BY a.id, a.label) SELECT round(avg((label = other)::INT), 6) AS purity FROM n")
def nn_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.neighbour_purity(embeddings(spark, sf_dir))


@query(E + """, m AS (SELECT a.id, a.label, b.label AS other, avg(greatest(1 - list_inner_product(a.v, b.v), 0)) AS d FROM u a JOIN u b ON a.id <> b.id GROUP BY ALL),
    s AS (SELECT id, max(d) FILTER (WHERE label = other) AS a, min(d) FILTER (WHERE label <> other) AS b FROM m GROUP BY id)
    SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s""")  # fmt: skip
def silhouette_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.silhouette(embeddings(spark, sf_dir))


@query(C + """, s AS (SELECT label, list_inner_product(v, centroid) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(centroid, centroid))) AS sim FROM u JOIN c USING (label))
    SELECT label, count(*) AS n, round(avg(sim), 6) AS mean, round(quantile_cont(sim, 0.5), 6) AS median, round(quantile_cont(sim, 0.25), 6) AS p25, round(quantile_cont(sim, 0.75), 6) AS p75, round(min(sim), 6) AS least, round((SELECT avg(list_inner_product(a.v, b.v)) FROM u a JOIN u b ON a.label = b.label AND a.id <> b.id WHERE a.label = s.label), 6) AS intra, round((SELECT max(list_cosine_similarity(x.centroid, y.centroid)) FROM c x JOIN c y ON x.label <> y.label WHERE x.label = s.label), 6) AS nearest FROM s GROUP BY label""")  # fmt: skip
def cluster_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.unit(embeddings(spark, sf_dir))
    return vectors.cluster_quality(rows, vectors.centroids(rows)).select("label", "n", "mean", "median", "p25", "p75", "least", "intra", "nearest")


@query(E + """, n AS (SELECT id, label, sqrt(list_inner_product(raw, raw)) AS norm FROM e), m AS (SELECT *, median(norm) OVER (PARTITION BY label) AS mid, count(*) OVER (PARTITION BY label) AS size FROM n),
    d AS (SELECT *, median(abs(norm - mid)) OVER (PARTITION BY label) AS mad FROM m)
    SELECT id, label, round(norm, 6) AS norm, size <= 3 OR mad < 1e-10 OR mid - 1.5 * 1.4826 * mad <= 0 OR norm >= mid - 1.5 * 1.4826 * mad AS keep FROM d""")  # fmt: skip
def mad_norm_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.norm_outliers(embeddings(spark, sf_dir), 1.5).select("id", "label", F.round("norm", 6).alias("norm"), "keep")


ISLANDS = ", r AS (SELECT *, max(e) OVER (PARTITION BY key ORDER BY s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM t), g AS (SELECT *, sum((reach IS NULL OR s - reach > {gap})::INT) OVER (PARTITION BY key ORDER BY s, id) AS island FROM r), m AS (SELECT key, island, min(s) AS s, max(e) AS e, count(*) AS n FROM g GROUP BY key, island)"


@query(I + ISLANDS.format(gap="21600") + " SELECT key, island::BIGINT AS island, round(s, 3) AS start, round(e, 3) AS \"end\", n FROM m")
def gap_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals.merge(timeline(spark, sf_dir), 6 * HOUR)
    return rows.select("key", "island", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "n")


@query(I + """, a AS (SELECT *, sum((lag IS DISTINCT FROM label)::INT) OVER (PARTITION BY key ORDER BY s, id) AS turn FROM (SELECT *, lag(label) OVER (PARTITION BY key ORDER BY s, id) AS lag FROM t)),
    b AS (SELECT *, max(e) OVER (PARTITION BY key, turn ORDER BY s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM a),
    c AS (SELECT *, sum((reach IS NULL OR s - reach > 86400)::INT) OVER (PARTITION BY key, turn ORDER BY s, id) AS part FROM b)
    SELECT key, any_value(label) AS label, round(min(s), 3) AS start, round(max(e), 3) AS "end", count(*) AS n FROM c GROUP BY key, turn, part""")  # fmt: skip
def merge_same_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge_same_label(timeline(spark, sf_dir), 24 * HOUR).select("key", "label", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "n")


@query("WITH RECURSIVE " + I[5:] + """, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s, id) AS k FROM t),
    w AS (SELECT key, k, s, e, s AS gs, 1 AS grp FROM o WHERE k = 1
          UNION ALL SELECT o.key, o.k, o.s, o.e, CASE WHEN o.s - w.e > 21600 OR o.e - w.gs > 172800 THEN o.s ELSE w.gs END, CASE WHEN o.s - w.e > 21600 OR o.e - w.gs > 172800 THEN w.grp + 1 ELSE w.grp END FROM w JOIN o ON o.key = w.key AND o.k = w.k + 1)
    SELECT key, round(min(s), 3) AS start, round(arg_max(e, k), 3) AS "end", count(*) AS n FROM w GROUP BY key, grp""")  # fmt: skip
def speech_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.capped_groups(timeline(spark, sf_dir), 6 * HOUR, 48 * HOUR).select("key", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "n")


PAIR = I + " SELECT a.key, a.id, b.id AS id_b FROM t a JOIN t b ON a.key = b.key WHERE a.label = 'click' AND b.label <> 'click' AND "
WIDE = I.replace("epoch_us(ts) / 1e6 + 1800 + event_id % 7200 AS e", "epoch_us(ts) / 1e6 + CASE WHEN event_type = 'click' THEN 600 ELSE 43200 END AS e") + " SELECT a.key, a.id, b.id AS id_b FROM t a JOIN t b ON a.key = b.key WHERE a.label = 'click' AND b.label <> 'click' AND "


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = timeline(spark, sf_dir)
    return rows.where("label = 'click'"), rows.where("label <> 'click'")


@query(PAIR + "a.e > b.s AND a.s < b.e")
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.overlaps(*_two(spark, sf_dir), 3 * HOUR).select("key", "id", "id_b")


@query(WIDE + "a.s >= b.s AND a.e <= b.e")
def containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timeline(spark, sf_dir).withColumn("end", F.col("start") + F.when(F.col("label") == "click", 600).otherwise(43200))
    return intervals.contained_in(rows.where("label = 'click'"), rows.where("label <> 'click'"), 3 * HOUR).select("key", "id", "id_b")


@query(I + ", x AS (SELECT * FROM t WHERE label = 'click'), y AS (SELECT * FROM t WHERE label <> 'click')" + ISLANDS.format(gap="0").replace("FROM t)", "FROM y)") + """
    SELECT x.key, x.id, round(coalesce(sum(CASE WHEN m.s IS NOT NULL THEN least(x.e, m.e) - greatest(x.s, m.s) END), 0) / greatest(any_value(x.e - x.s), 1e-6), 6) AS share FROM x LEFT JOIN m ON x.key = m.key AND x.e > m.s AND x.s < m.e GROUP BY x.key, x.id""")  # fmt: skip
def overlap_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.overlap_share(*_two(spark, sf_dir), 3 * HOUR).withColumn("share", F.round("share", 6))


@query(I + """, k AS (SELECT * FROM t WHERE label = 'purchase'), b AS (SELECT t.key, t.id, arg_min(k.id, (abs(t.s - k.s), k.s, CASE WHEN k.s <= t.s THEN -k.id ELSE k.id END)) AS nearest FROM t LEFT JOIN k ON k.key = t.key GROUP BY t.key, t.id) SELECT * FROM b""")
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.nearest_in_time(timeline(spark, sf_dir), F.col("label") == "purchase", "id").select("key", "id", "nearest")


@query(I + """, w AS (SELECT key, id, s, e, unnest(CASE WHEN e - s < 1200 THEN []::DOUBLE[] WHEN e - s < 2700 THEN [s] ELSE list_concat(list_transform(range(0, floor((e - s - 2700) / 1350 + 1e-9)::BIGINT + 1), lambda k: s + k * 1350), CASE WHEN floor((e - s - 2700) / 1350 + 1e-9) * 1350 + 2700 < e - s - 1e-9 THEN [e - 2700] ELSE [] END) END) AS p FROM t)
    SELECT key, id, round(p, 3) AS start, round(least(p + 2700, e), 3) AS "end" FROM w""")  # fmt: skip
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.sliding_windows(timeline(spark, sf_dir), 2700.0, 1350.0, 1200.0).select("key", "id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query("WITH RECURSIVE d AS (SELECT conv_id, turn, ceil(len(text) / 4)::BIGINT AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations), w AS (SELECT conv_id, turn, k, 0 AS batch, tokens AS used FROM d WHERE k = 1 UNION ALL SELECT d.conv_id, d.turn, d.k, CASE WHEN w.used > 0 AND w.used + d.tokens > 300 THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.used > 0 AND w.used + d.tokens > 300 THEN d.tokens ELSE w.used + d.tokens END FROM w JOIN d ON d.conv_id = w.conv_id AND d.k = w.k + 1) SELECT conv_id, turn, batch::INT AS batch FROM w")
def token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("pos"), F.ceil(F.length("text") / 4).cast("bigint").alias("tokens"))
    return batching.token_batches(rows, 300).select(F.col("key").alias("conv_id"), F.col("pos").alias("turn"), "batch")


@query(O + ", l AS (SELECT chapter, scene, alias, CASE WHEN scene % 3 = 0 THEN '' ELSE upper(alias) END AS canonical FROM o WHERE scene % 2 = 0 OR scene % 3 = 0) SELECT o.chapter, o.scene, o.alias, coalesce(nullif(l.canonical, ''), o.alias) AS canonical FROM o LEFT JOIN l USING (chapter, scene, alias)")
def canonical_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = occurrences(spark, sf_dir)
    lookup = rows.where("scene % 2 = 0 OR scene % 3 = 0").withColumn("canonical", F.when(F.col("scene") % 3 == 0, "").otherwise(F.upper("alias")))
    return entities.canonical(rows, lookup).select("chapter", "scene", "alias", "canonical")


@query(O + " SELECT * FROM o WHERE NOT (scene % 2 = 0) AND NOT (scene % 5 = 0)")
def missed_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = occurrences(spark, sf_dir)
    return entities.missed(rows, rows.where("scene % 2 = 0"), rows.where("scene % 5 = 0"))


@query(O + ", m AS (SELECT chapter, scene, alias, CASE WHEN alias < 'm' THEN left(alias, 1) ELSE alias END AS canonical FROM o) SELECT canonical, count(*) AS n, count(DISTINCT chapter) AS chapters FROM m GROUP BY canonical")
def merge_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = occurrences(spark, sf_dir).withColumn("canonical", F.col("alias"))
    merges = rows.where("alias < 'm'").select(F.col("alias").alias("absorb"), F.substring("alias", 1, 1).alias("keep")).distinct()
    return entities.merged(rows, merges).groupBy("canonical").agg(F.count("*").alias("n"), F.count_distinct("chapter").alias("chapters"))


@query("SELECT doc_id, len(trim(text)) AS n, substr(trim(string_split(trim(text), chr(10))[1]), 1, 80) AS title, replace(replace(source || '/' || lang, '/', '_'), chr(92), '_') AS name FROM documents")
def text_basics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length(T.normalize_text(F.col("text"))).cast("bigint").alias("n"), T.infer_title(F.col("text")).alias("title"), T.safe_name(F.concat("source", F.lit("/"), "lang")).alias("name"))


_H1, _TITLE = r"'(?is)<h1\b[^>]*>(.*?)</h1\s*>'", r"'(?is)<title\b[^>]*>(.*?)</title\s*>'"
_BARE = r"regexp_replace(regexp_extract(html, {0}, 1), '(?s)<[^>]*>', '', 'g')"
_CHARS = "replace(replace(replace(replace(replace(replace(replace({0}, '&copy;', chr(169)), '&middot;', chr(183)), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&nbsp;', chr(160)), '&amp;', '&')"


@query(f"""SELECT page_id, CASE WHEN regexp_matches(html, {_H1}) THEN array_to_string(list_filter(list_transform(string_split({_CHARS.format(_BARE.format(_H1))}, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10))
    WHEN regexp_matches(html, {_TITLE}) THEN trim({_CHARS.format(_BARE.format(_TITLE))}, chr(32) || chr(9) || chr(10) || chr(13)) END AS title FROM pages""")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.html_title(F.col("html")).alias("title"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g'), '(?i)<br\b[^>]*>', chr(10), 'g'), '(?i)</p\s*>', chr(10) || chr(10), 'g'), '(?s)<!--.*?-->|<[^>]*>', '', 'g') AS x FROM pages),
    b AS (SELECT page_id, list_filter(list_transform(string_split({chars}, chr(10)), lambda s: trim(regexp_replace(s, '[\s\x{A0}]+', ' ', 'g'))), lambda s: s <> '') AS l FROM a) SELECT page_id, array_to_string(l, chr(10)) AS text FROM b""".replace("{chars}", _CHARS.format("x")))
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@query("WITH n AS (SELECT doc_id % 50 AS character, doc_id, lang, source, n_chars FROM documents), k AS (SELECT character, lang, source, n_chars // 100 AS size FROM n) SELECT character, count(*) AS n FROM (SELECT DISTINCT * FROM k) GROUP BY character")
def note_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes as JSON, with their keys in one order or the other; repeats go whatever the order."""
    size = (F.col("n_chars") / 100).cast("long").alias("size")
    note = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct("lang", "source", size))).otherwise(F.to_json(F.struct(size, "source", "lang")))
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("character"), note.alias("note"), F.lit(0).alias("chapter_index"), F.lit(0).alias("scene_index"))
    return entities.distinct_notes(rows).groupBy("character").agg(F.count("*").alias("n"))


@query("SELECT user_id AS key, event_type AS speaker, round(min(epoch_us(ts)) / 1e6, 3) AS first_seen FROM events WHERE event_type <> 'view' GROUP BY ALL")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timeline(spark, sf_dir).withColumn("speaker", F.when(F.col("label") == "view", "UNKNOWN").otherwise(F.col("label")))
    return transcript.first_seen(rows).withColumn("first_seen", F.round("first_seen", 3))


COVER = "WITH n AS (SELECT conv_id, turn, len(text) AS n, sum(len(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations), s AS (SELECT conv_id AS chapter, b - n + CASE WHEN conv_id % 3 = 1 AND turn = 1 THEN 1 ELSE 0 END AS a, b + CASE WHEN conv_id % 5 = 1 THEN 1 ELSE 0 END AS b, max(b) OVER (PARTITION BY conv_id) AS total FROM n)"


@query(COVER + ", l AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY chapter ORDER BY a, b), 0) AS last FROM s) SELECT chapter, bool_and(a = last AND b > a) AND max(b) = max(total) AS covered FROM l GROUP BY chapter")
def coverage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as scenes of a chapter; a third of the chapters have a gap, a fifth pass their end."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    n, b = F.length("text"), F.sum(F.length("text")).over(w)
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chapter"), "turn", (b - n).alias("a"), b.alias("b"), F.sum(n).over(Window.partitionBy("conv_id")).alias("total"))
    gap = F.when((F.col("chapter") % 3 == 1) & (F.col("turn") == 1), 1).otherwise(0)
    return entities.coverage(rows.select("chapter", (F.col("a") + gap).alias("start"), (F.col("b") + F.when(F.col("chapter") % 5 == 1, 1).otherwise(0)).alias("end"), "total"))


@query("SELECT vec_id AS id, label, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.vectors import norm

    return embeddings(spark, sf_dir).select("id", "label", F.round(norm(F.col("v")), 6).alias("norm"))


@query(E + ", p AS (SELECT a.label, a.id, round(sum(list_inner_product(a.v, b.v) * (1 + b.id % 5)) / sum(1 + b.id % 5), 9) AS m FROM u a JOIN u b USING (label) GROUP BY a.label, a.id) SELECT label, arg_max(id, (m, -id)) AS medoid FROM p GROUP BY label")
def weighted_medoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.medoids(embeddings(spark, sf_dir).withColumn("w", 1 + F.col("id") % 5), "w")


COHERENT = E + ", p AS (SELECT a.label, a.id, avg(list_inner_product(a.v, b.v)) FILTER (WHERE a.id <> b.id) AS m FROM u a JOIN u b USING (label) GROUP BY a.label, a.id), h AS (SELECT label, round(coalesce(max(m), 1.0), 6) AS c FROM p GROUP BY label)"


@query(COHERENT + " SELECT id, label FROM e WHERE label IN (SELECT label FROM h WHERE c >= (SELECT median(c) FROM h))")
def coherence_filter_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir)
    bar = vectors.coherence(rows).agg(F.median(F.round("coherence", 6))).first()[0]
    return vectors.coherent_labels(rows, bar - 5e-7).select("id", "label")


@query("WITH s AS (SELECT CASE WHEN vec_id % 7 = 0 THEN 1000 + vec_id ELSE label END AS label FROM embeddings), c AS (SELECT label, count(*) AS n FROM s WHERE label <> -1 GROUP BY label) SELECT round(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) / sum(n), 6) AS fraction FROM c")
def singleton_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir).withColumn("label", F.when(F.col("id") % 7 == 0, 1000 + F.col("id")).otherwise(F.col("label")))
    return vectors.singleton_fraction(rows).select(F.round("fraction", 6).alias("fraction"))


SWEEP = "WITH g AS (SELECT label AS pos, avg(embedding[1]::DOUBLE) AS silhouette, avg(embedding[2]::DOUBLE) AS nn_purity, max(embedding[3]::DOUBLE) AS sep, min(embedding[4]::DOUBLE) AS disagree, count(*) AS n_noise FROM embeddings GROUP BY label), z AS (SELECT *, 0.5 * (silhouette - avg(silhouette) OVER ()) / stddev_pop(silhouette) OVER () + 3 * (nn_purity - avg(nn_purity) OVER ()) / stddev_pop(nn_purity) OVER () + 0.5 * (sep - avg(sep) OVER ()) / stddev_pop(sep) OVER () - 3 * (disagree - avg(disagree) OVER ()) / stddev_pop(disagree) OVER () AS score FROM g)"


def sweep_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = lambda k: F.get("v", F.lit(k))
    rows = embeddings(spark, sf_dir).groupBy(F.col("label").alias("pos")).agg(F.avg(v(0)).alias("silhouette"), F.avg(v(1)).alias("nn_purity"), F.max(v(2)).alias("sep"), F.min(v(3)).alias("disagree"), F.count("*").alias("n_noise"))
    return vectors.zscores(rows, {"silhouette": (0.5, True), "nn_purity": (3.0, True), "sep": (0.5, True), "disagree": (3.0, False)})


@query(SWEEP + " SELECT pos, round(score, 6) AS score, row_number() OVER (ORDER BY nn_purity DESC, pos) AS rank_nn_purity, row_number() OVER (ORDER BY disagree, pos) AS rank_disagree FROM z")
def zscore_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.metric_ranks(sweep_rows(spark, sf_dir), {"nn_purity": True, "disagree": False})
    return rows.select("pos", F.round("score", 6).alias("score"), "rank_nn_purity", "rank_disagree")


@query(SWEEP + " SELECT pos, round(score, 6) AS score FROM z ORDER BY score DESC, sep DESC, disagree, nn_purity DESC, silhouette DESC, n_noise, pos LIMIT 1")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.best_candidate(sweep_rows(spark, sf_dir)).select("pos", F.round("score", 6).alias("score"))


@query(SWEEP + " SELECT 'sep' AS metric, round(min(sep), 6) AS least, round(max(sep), 6) AS most, arg_max(pos, (sep, -pos)) AS best_pos FROM z UNION ALL SELECT 'disagree', round(min(disagree), 6), round(max(disagree), 6), arg_min(pos, (disagree, pos)) FROM z")
def metric_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.metric_spans(sweep_rows(spark, sf_dir), {"sep": True, "disagree": False})
    return rows.select("metric", F.round("least", 6).alias("least"), F.round("most", 6).alias("most"), "best_pos")


@query(E + ", p AS (SELECT CASE WHEN a.label = b.label THEN 'within' ELSE 'between' END AS kind, list_inner_product(a.v, b.v) AS s FROM u a JOIN u b ON a.id < b.id) SELECT kind, count(*) AS n, round(min(s), 6) AS least, round(max(s), 6) AS most, round(avg(s), 6) AS mean FROM p GROUP BY kind")
def pairwise_diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.pair_diagnostics(embeddings(spark, sf_dir)).select("kind", "n", *[F.round(c, 6).alias(c) for c in ("least", "most", "mean")])


@query(E + ", p AS (SELECT a.label, avg(list_inner_product(a.v, b.v)) AS m, count(DISTINCT a.id) AS n FROM u a JOIN u b ON a.label = b.label AND a.id <> b.id GROUP BY a.label) SELECT label, n, greatest(4, least(12, 4 + round_even(8 * (1 - power(greatest(m, 0), 2.2)), 0)::INT)) AS target FROM p")
def diversity_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.diversity_target(embeddings(spark, sf_dir), 4, 12)


GREEDY = """, p AS (SELECT label, list(id ORDER BY id) AS ids, list(v ORDER BY id) AS vs, count(*)::INT AS n FROM u GROUP BY label),
    w AS (SELECT label, {start} AS chosen, list_transform(vs, lambda x: {near}) AS near FROM p
          UNION ALL SELECT label, list_append(chosen, i), list_transform(range(1, n + 1), lambda j: greatest(near[j], round(list_inner_product(vs[j], vs[i]), 12)))
          FROM (SELECT p.*, w.chosen, w.near, list_sort(list_transform(list_filter(range(1, n + 1), lambda j: NOT list_contains(w.chosen, j::INT)), lambda j: {{'s': w.near[j], 'j': j::INT}}))[1].j AS i FROM w JOIN p USING (label) WHERE len(w.chosen) < least(8, n)))
    SELECT label, ids[k] AS id FROM (SELECT label, ids, unnest(chosen) AS k FROM w JOIN p USING (label) WHERE len(chosen) = least(8, n))"""
_NEAR = "round(list_inner_product(x, vs[{0}]), 12)"


@query("WITH RECURSIVE " + E[5:] + GREEDY.format(start="[1::INT]", near=_NEAR.format(1)))
def maxmin_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight rows of each label, each the least similar to those chosen before."""
    return vectors.select_diverse(embeddings(spark, sf_dir), 8)


@query("WITH RECURSIVE " + E[5:] + GREEDY.format(start="[1::INT, n, 2::INT]", near=f"greatest({_NEAR.format(1)}, {_NEAR.format('n')}, {_NEAR.format(2)})"))
def anchored_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the first and the last row."""
    return vectors.select_diverse(embeddings(spark, sf_dir), 8, anchors=True)


@query("WITH RECURSIVE " + E[5:] + """, m AS (SELECT a.id, a.label, any_value(a.v) AS v, round((sum(list_inner_product(a.v, b.v)) - any_value(list_inner_product(a.v, a.v)) + 1) / count(*), 9) AS mean FROM u a JOIN u b USING (label) GROUP BY a.id, a.label),
    o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY mean DESC, id) AS k FROM m),
    w AS (SELECT label, k, id, true AS stays, [v] AS kept FROM o WHERE k = 1
          UNION ALL SELECT o.label, o.k, o.id, list_bool_and(list_transform(w.kept, lambda x: list_inner_product(x, o.v) >= 0)), CASE WHEN list_bool_and(list_transform(w.kept, lambda x: list_inner_product(x, o.v) >= 0)) THEN list_append(w.kept, o.v) ELSE w.kept END FROM w JOIN o ON o.label = w.label AND o.k = w.k + 1)
    SELECT id, label FROM w WHERE stays""")  # fmt: skip
def coherent_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.coherent_members(embeddings(spark, sf_dir), 0.0)


@query(C + ", s AS (SELECT u.id, u.label, c.label AS other, round(list_cosine_similarity(u.v, c.centroid), 9) AS sim FROM u, c), b AS (SELECT id, label, arg_max(other, (sim, -other)) AS best, max(sim) AS sim FROM s GROUP BY id, label) SELECT id, label, best, round(sim, 6) AS sim FROM b WHERE sim >= 0.2")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.unit(embeddings(spark, sf_dir))
    return vectors.nearest_centroid(rows, vectors.centroids(rows), 0.2).withColumn("sim", F.round("sim", 6))


@query("WITH s AS (SELECT CASE WHEN vec_id % 4 = 0 THEN -1 ELSE label END AS label FROM embeddings), c AS (SELECT label, count(*) AS n FROM s GROUP BY label) SELECT round(sum(n) FILTER (WHERE label < 0) / sum(n), 6) AS noise_fraction, count(*) FILTER (WHERE label >= 0) AS n_clusters, round(max(n) FILTER (WHERE label >= 0) / sum(n) FILTER (WHERE label >= 0), 6) AS max_cluster_ratio FROM c")
def clustering_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir).withColumn("label", F.when(F.col("id") % 4 == 0, -1).otherwise(F.col("label")))
    return vectors.clustering_row(rows).select(F.round("noise_fraction", 6).alias("noise_fraction"), "n_clusters", F.round("max_cluster_ratio", 6).alias("max_cluster_ratio"))


@query("WITH c AS (SELECT list(n ORDER BY n DESC) AS l FROM (SELECT count(*) AS n FROM embeddings WHERE label <> -1 GROUP BY label)) SELECT l[1] AS top_1, l[5] AS top_5, l[10] AS top_10, l[20] AS top_20, l[30] AS top_30 FROM c")
def size_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.size_statistics(embeddings(spark, sf_dir))


_COS = "list_inner_product({0}, {1}) / (greatest(sqrt(list_inner_product({0}, {0})), 1e-10) * greatest(sqrt(list_inner_product({1}, {1})), 1e-10))"


@query(C + f""", s AS (SELECT u.id, u.id % 40 AS segment, u.v, c.label AS other, round({_COS.format("u.v", "c.centroid")}, 9) AS sim FROM u, c),
    b AS (SELECT id, any_value(segment) AS segment, any_value(v) AS v, arg_max(other, (sim, -other)) AS best, max(sim) AS sim FROM s GROUP BY id),
    g AS (SELECT segment, best, round(sum(sim), 9) AS total, min(id) AS first FROM b GROUP BY ALL),
    t AS (SELECT segment, best AS voted FROM g QUALIFY row_number() OVER (PARTITION BY segment ORDER BY total DESC, first) = 1),
    x AS (SELECT id, v, best, voted AS label FROM b JOIN t USING (segment)),
    m AS (SELECT a.id, a.label, y.label AS other, avg(greatest(1 - list_inner_product(a.v, y.v), 0)) AS d FROM x a JOIN x y ON a.id <> y.id GROUP BY ALL),
    q AS (SELECT id, max(d) FILTER (WHERE label = other) AS a, min(d) FILTER (WHERE label <> other) AS b FROM m GROUP BY id)
    SELECT round((SELECT avg((best <> label)::INT) FROM x) / sqrt((SELECT count(DISTINCT label) FROM e WHERE label <> -1)), 6) AS disagreement,
           (SELECT round(coalesce(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END), 0), 6) FROM q) AS separation""")  # fmt: skip
def vote_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.vote_consistency(embeddings(spark, sf_dir).withColumn("segment", F.col("id") % 40)).withColumn("disagreement", F.round("disagreement", 6))


def hundredths(rows: DataFrame) -> DataFrame:
    """The queries of a search: every row whose id is divisible by 100."""
    return rows.where(F.col("id") % 100 == 0)


@query(E + " SELECT a.id AS query, b.id, round(round(list_inner_product(a.v, b.v), 9), 6) AS sim FROM u a, u b WHERE a.id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(list_inner_product(a.v, b.v), 9) DESC, b.id) <= 10")
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all rows to every row whose id is divisible by 100."""
    rows = embeddings(spark, sf_dir)
    return index.exact_search(rows, hundredths(rows)).withColumn("sim", F.round("sim", 6))


@query(E + " SELECT a.id AS query, b.id, round(round(list_inner_product(a.v, b.v), 9), 6) AS sim FROM u a, u b WHERE a.id % 100 = 0 AND b.label IN (1, 2, 3) QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(list_inner_product(a.v, b.v), 9) DESC, b.id) <= 10")
def filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among rows of three labels, as a filter of the search."""
    rows = embeddings(spark, sf_dir)
    return index.exact_search(rows, hundredths(rows), filters={"label": {"$in": [1, 2, 3]}}).withColumn("sim", F.round("sim", 6))


@query()
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the inverted lists of all rows: nearly all of the nearest, so that no SQL gives these rows; ``index_recall`` measures it."""
    rows = embeddings(spark, sf_dir)
    return index.build(rows).search(hundredths(rows)).withColumn("sim", F.round("sim", 6))


@query("SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 100 = 0")
def index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the index finds nine tenths of what the exact search finds."""
    rows = embeddings(spark, sf_dir)
    both = index.recall(index.build(rows).search(hundredths(rows)), index.exact_search(rows, hundredths(rows)))
    return both.select("queries", (F.col("recall") >= 0.9).alias("enough"))


@query("SELECT vec_id AS id, k AS frame, round(list_sum(list_transform(list_slice(embedding, k * 24 + 1, k * 24 + 24), lambda x: x::DOUBLE)), 6) AS total FROM embeddings, range(3) r(k)")
def tumbling_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals.frames(embeddings(spark, sf_dir).select(F.lit(0).alias("key"), "id", F.col("v").alias("samples")), 24)
    return rows.select("id", F.col("frame").cast("long").alias("frame"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(I + ", m AS (SELECT a.key, a.id, arg_max(b.label, (round(least(a.e, b.e) - greatest(a.s, b.s), 9), -b.id)) AS label FROM t a JOIN t b ON a.key = b.key AND a.e > b.s AND a.s < b.e WHERE a.label = 'click' AND b.label <> 'click' GROUP BY a.key, a.id) SELECT t.key, t.id, coalesce(m.label, 'SPEAKER_00') AS label FROM t LEFT JOIN m USING (key, id) WHERE t.label = 'click'")
def argmax_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.longest_overlap(*_two(spark, sf_dir), 3 * HOUR, "SPEAKER_00")


@query(I + ", w AS (SELECT *, lag(label) OVER o AS pl, lag(e) OVER o AS pe, lead(label) OVER o AS nl, lead(s) OVER o AS ns FROM t WINDOW o AS (PARTITION BY key ORDER BY s, id)) SELECT key, id FROM w WHERE coalesce(pl = label AND pe >= s - 21600, false) OR coalesce(nl = label AND ns <= e + 21600, false)")
def neighbor_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.supported(timeline(spark, sf_dir), 6 * HOUR).select("key", "id")


@query(I + ", w AS (SELECT *, label IN ('click', 'view') AS o, lead(s) OVER w AS ns FROM t WINDOW w AS (PARTITION BY key ORDER BY s, id)), r AS (SELECT *, sum((o IS DISTINCT FROM lo)::INT) OVER (PARTITION BY key ORDER BY s, id) AS g FROM (SELECT *, coalesce(lag(o) OVER (PARTITION BY key ORDER BY s, id), false) AS lo FROM w)), x AS (SELECT key, max(e) AS total FROM t GROUP BY key), y AS (SELECT r.key, min(s) AS a, coalesce(arg_max(coalesce(ns, total), (s, id)), any_value(total)) AS b FROM r JOIN x ON x.key = r.key WHERE o GROUP BY r.key, g) SELECT key, round(a, 3) AS start, round(b, 3) AS \"end\" FROM y WHERE b - a > 7200")
def run_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timeline(spark, sf_dir)
    found = intervals.runs(rows, F.col("label").isin("click", "view"), rows.groupBy("key").agg(F.max("end").alias("total")), 2 * HOUR)
    return found.select("key", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query(I + " SELECT key, id, last_value(CASE WHEN label = 'purchase' THEN id END IGNORE NULLS) OVER (PARTITION BY key ORDER BY s, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS known FROM t")
def asof_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.last_known(timeline(spark, sf_dir).withColumn("bought", F.when(F.col("label") == "purchase", F.col("id"))), "bought").select("key", "id", "known")


@query(I + " SELECT key, count(*) AS n, round(sum(greatest(e - s, 0)), 3) AS seconds, round(avg((id % 100) / 100), 4) AS mean_quality, count(*) FILTER (WHERE (id % 100) / 100 < 0.3) AS n_low, round(max(abs(id % 13 - 6)), 2)::DOUBLE AS shift_ms FROM t GROUP BY key")
def stats_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timeline(spark, sf_dir).withColumn("quality", (F.col("id") % 100) / 100).withColumn("shift_ms", (F.col("id") % 13 - 6).cast("double"))
    return intervals.speech_statistics(rows)


@query("WITH n AS (SELECT strftime(ts, '%Y%m%d-%H%M%S') || '_' || event_id AS name FROM events UNION ALL SELECT 'no-time_' || user_id FROM (SELECT DISTINCT user_id FROM events)), a AS (SELECT name, try_strptime(substr(name, 1, 15), '%Y%m%d-%H%M%S') AS t0 FROM n), b AS (SELECT a.*, epoch(m.last) - epoch(a.t0) AS age FROM a, (SELECT max(t0) AS last FROM a) m), c AS (SELECT name, coalesce(age > 14400, false) AS old, CASE WHEN age <= 86400 THEN strftime(t0, '%Y%m%d%H') ELSE strftime(t0, '%Y%m%d') END AS bucket FROM b) SELECT name, NOT old OR row_number() OVER (PARTITION BY old, bucket ORDER BY name DESC) = 1 AS keep FROM c")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as snapshots, seen from the last one's time."""
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_id", "user_id")
    names = events.select(F.concat(F.date_format("ts", snapshots.STAMP), F.lit("_"), F.col("event_id").cast("string")).alias("name"))
    names = names.union(events.select(F.concat(F.lit("no-time_"), F.col("user_id").cast("string"))).distinct())
    now = events.agg(F.date_trunc("second", F.max("ts"))).first()[0]
    return snapshots.retained(names, F.lit(now)).select("name", "keep")


@query(I + ", p AS (SELECT key, id, greatest(s - 900, 0) AS s, e + 900 AS e FROM t), r AS (SELECT *, max(e) OVER (PARTITION BY key ORDER BY s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p), g AS (SELECT *, sum((reach IS NULL OR s > reach)::INT) OVER (PARTITION BY key ORDER BY s, id) AS island FROM r) SELECT key, round(min(s), 3) AS start, round(max(e), 3) AS \"end\" FROM g GROUP BY key, island")
def padded_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.padded(timeline(spark, sf_dir), 900.0).select("key", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query(I + " SELECT key, id, k AS win, round(s + k * 1800, 3) AS start, round(least(s + k * 1800 + 3600, e), 3) AS \"end\" FROM t, range(6) r(k) WHERE k < ceil((e - s) / 1800)")
def file_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals.file_windows(timeline(spark, sf_dir), 3600.0, 1800.0)
    return rows.select("key", "id", F.col("win").cast("long").alias("win"), F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query()
def overlap_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold that changes the row before: checked against brute force in the tests."""
    return intervals.repair_overlaps(timeline(spark, sf_dir).withColumn("quality", (F.col("id") % 100) / 100), 60.0)


@query("WITH RECURSIVE " + I[5:] + """, x AS (SELECT key, max(e) AS total FROM t GROUP BY key), base AS (SELECT key, id, s, e FROM t WHERE label = 'purchase'),
    more AS (SELECT t.key, t.id, greatest(t.s, 0) AS s, least(t.e, x.total) AS e FROM t JOIN x USING (key) WHERE t.label = 'click'),
    every AS (SELECT *, 0 AS new FROM base UNION ALL SELECT *, 1 AS new FROM more WHERE e - s >= 0.08),
    r AS (SELECT *, max(CASE WHEN new = 0 THEN e END) OVER (PARTITION BY key ORDER BY s, new, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, min(CASE WHEN new = 0 THEN s END) OVER (PARTITION BY key ORDER BY s, new, e, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM every),
    f AS (SELECT key, id, s, e, row_number() OVER (PARTITION BY key ORDER BY s, e, id) AS k FROM r WHERE new = 1 AND NOT coalesce(s < before + 600, false) AND NOT coalesce(e > after - 600, false)),
    w AS (SELECT key, k, id, s, e, true AS taken, e AS upto FROM f WHERE k = 1
          UNION ALL SELECT f.key, f.k, f.id, f.s, f.e, f.s >= w.upto + 600, CASE WHEN f.s >= w.upto + 600 THEN greatest(w.upto, f.e) ELSE w.upto END FROM w JOIN f ON f.key = w.key AND f.k = w.k + 1)
    SELECT key, id, round(s, 3) AS start, round(e, 3) AS "end", (id % 100) / 100 AS quality FROM w WHERE taken""")  # fmt: skip
def rescued_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timeline(spark, sf_dir).withColumn("quality", (F.col("id") % 100) / 100)
    totals = rows.groupBy("key").agg(F.max("end").alias("total"))
    return intervals.rescued(rows.where("label = 'purchase'"), rows.where("label = 'click'"), totals, 600.0)


@query(I + ", x AS (SELECT key, max(e) AS total FROM t WHERE label <> 'click' GROUP BY key), b AS (SELECT t.key, greatest(s, 0) AS s, least(e, total) AS e FROM t JOIN x USING (key) WHERE label = 'click'), h AS (SELECT * FROM b WHERE e > s AND e - s >= 5400), w AS (SELECT key, 0::DOUBLE AS s, total AS e FROM x WHERE key NOT IN (SELECT key FROM t WHERE label = 'click')), a AS (SELECT * FROM h UNION ALL SELECT * FROM w) SELECT key, row_number() OVER (PARTITION BY key ORDER BY s, e) - 1 AS index, round(s, 3) AS start, round(e, 3) AS \"end\" FROM a")
def speech_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks, others = _two(spark, sf_dir)
    spans = transcript.speech_spans(clicks, others.groupBy("key").agg(F.max("end").alias("total")), 5400.0)
    return spans.select("key", F.col("index").cast("long").alias("index"), F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query("SELECT conv_id, turn FROM conversations WHERE coalesce((turn % 10) / 10 + 0.3 >= 0.6, true) AND turn * 2.0 >= 0.3 AND CASE WHEN turn > 0 THEN len(text) / (turn * 2.0) ELSE 'infinity'::DOUBLE END <= 28")
def entry_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit(0.0).alias("start"), (F.col("turn") * 2.0).alias("end"), "text", ((F.col("turn") % 10) / 10 + 0.3).alias("confidence"))
    return transcript.passes(rows).select("conv_id", "turn")


SENTENCES = "WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^。！？!?]*[。！？!?]|[^。！？!?]+'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))), lambda x: x <> '') AS l, n_chars FROM documents)"


@query(SENTENCES + " SELECT doc_id, len(l) AS n, coalesce(list_sum(list_transform(l, lambda x: len(x))), 0)::BIGINT AS chars, md5(array_to_string(l, chr(10))) AS digest FROM p")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", transcript.sentences(F.col("text")).alias("l"))
    return rows.select("doc_id", F.size("l").cast("long").alias("n"), F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"), F.md5(F.array_join("l", "\n")).alias("digest"))


@query(SENTENCES + ", x AS (SELECT doc_id, unnest(l) AS t, unnest(range(len(l))) AS pos, n_chars / 10 AS e FROM p), c AS (SELECT *, sum(len(t)) OVER (PARTITION BY doc_id ORDER BY pos) AS upto, sum(len(t)) OVER (PARTITION BY doc_id) AS n FROM x) SELECT doc_id, pos, round(least(e, e * (upto - len(t)) / n), 6) AS piece_start, round(CASE WHEN upto = n THEN e ELSE least(e, e * upto / n) END, 6) AS piece_end FROM c")
def time_proportional_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.lit(0.0).alias("start"), (F.col("n_chars") / 10).alias("end"), F.posexplode(transcript.sentences(F.col("text"))).alias("pos", "text"))
    return transcript.proportional_times(rows).select(F.col("key").alias("doc_id"), F.col("pos").cast("long").alias("pos"), F.round("piece_start", 6).alias("piece_start"), F.round("piece_end", 6).alias("piece_end"))


@query()
def heuristic_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences and clauses by language: a small program for each text."""
    return table(spark, sf_dir, "documents").select("doc_id", transcript.pieces(F.col("text"), F.col("lang")).alias("l")).select("doc_id", F.size("l").alias("n"), F.md5(F.array_join("l", "\n")).alias("digest"))


@query("SELECT doc_id, len(trim(regexp_replace(text, '[。！？!?、，,.；;：:…—–\\-「」『』（）()【】\\[\\]《》〈〉\"'']', '', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))) AS n, md5(replace(trim(regexp_replace(text, '[。！？!?、，,.；;：:…—–\\-「」『』（）()【】\\[\\]《》〈〉\"'']', '', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)), ' ', '')) AS digest FROM documents")
def strip_punct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length(T.strip_marks(F.col("text"))).cast("long").alias("n"), F.md5(T.compact(F.col("text"))).alias("digest"))


@query("WITH x AS (SELECT event_id, event_id * 0.7311::DOUBLE AS t FROM events), m AS (SELECT event_id, t, floor(t)::BIGINT * 1000 + round_even((t - floor(t)) * 1000, 0)::BIGINT AS ms FROM x) SELECT event_id, printf('%02d:%02d:%02d', floor(t)::BIGINT // 3600, floor(t)::BIGINT % 3600 // 60, floor(t)::BIGINT % 60) AS clock, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 1000 % 3600 // 60, ms // 1000 % 60, ms % 1000) AS stamp, round(ms / 1000, 3) AS parsed FROM m")
def time_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_id") * F.lit(0.7311)
    return table(spark, sf_dir, "events").select("event_id", T.clock(t).alias("clock"), T.subtitle_time(t).alias("stamp"), F.round(T.parse_clock(T.subtitle_time(t)), 3).alias("parsed"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'en' ELSE lower(replace(lang || '_X', '_', '-')) END AS code, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'English' ELSE 'English' END AS aligner, coalesce(CASE lang WHEN 'en' THEN '英文' END, lower(replace(lang || '_X', '_', '-'))) AS recognizer FROM documents")
def language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("lang", F.lit("_X"))
    return table(spark, sf_dir, "documents").select("doc_id", T.language_code(name).alias("code"), speech.aligner_language(name).alias("aligner"), speech.recognizer_language(name).alias("recognizer"))


@query("WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), r AS (SELECT vec_id, sqrt(list_inner_product(v, v) / len(v)) AS rms FROM e) SELECT vec_id AS id, round(20 * log10(rms), 6) AS db, CASE WHEN 20 * log10(rms) < -38 THEN 'quiet' WHEN 20 * log10(rms) > -20 THEN 'loud' ELSE 'normal' END AS volume, CASE WHEN rms < 0.02 THEN 'low' WHEN rms > 0.05 THEN 'high' ELSE 'medium' END AS energy FROM r")
def level_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = speech.level_db(F.col("v"))
    rms = F.pow(F.lit(10.0), db / 20)
    return embeddings(spark, sf_dir).select("id", F.round(db, 6).alias("db"), speech.volume_class(db).alias("volume"), speech.energy_class(rms).alias("energy"))


LABELS = ("silence", "water", "crying", "crowd noise")


@query("WITH s AS (SELECT vec_id, [embedding[1], embedding[2], embedding[3], embedding[4]]::DOUBLE[] AS v FROM embeddings), t AS (SELECT vec_id, v, list_max(v) AS top, list_position(v, list_max(v)) AS pos, list_sort(v, 'DESC')[2] AS two FROM s) SELECT vec_id AS id, CASE WHEN top >= 0.05 AND top - two >= 0.02 AND pos <> 1 AND v[1] + 0.03 < top THEN ['silence', 'water', 'crying_or_sobbing', 'crowd'][pos] END AS label FROM t")
def sound_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = F.array(*[F.struct(F.lit(x).alias("label"), F.get("v", F.lit(k)).alias("sim")) for k, x in enumerate(LABELS)])
    return embeddings(spark, sf_dir).select("id", speech.top_label(scores, 0.05, 0.02).alias("label"))


@query(O + ", m AS (SELECT chapter, scene, alias, left(alias, 2) AS canonical FROM o WHERE scene % 2 = 0), r AS (SELECT DISTINCT left(alias, 2) AS canonical FROM o) SELECT r.canonical, count(m.alias) AS n, coalesce(string_agg(m.chapter || '/' || m.scene || '/' || m.alias, ',' ORDER BY m.chapter, m.scene, m.alias), '') AS places FROM r LEFT JOIN m USING (canonical) GROUP BY r.canonical")
def group_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = occurrences(spark, sf_dir).withColumn("canonical", F.substring("alias", 1, 2))
    found = entities.grouped(rows.select("canonical").distinct(), rows.where("scene % 2 = 0"))
    return found.select("canonical", F.size("places").cast("long").alias("n"), F.array_join(F.transform("places", lambda p: F.concat_ws("/", p["chapter"].cast("string"), p["scene"].cast("string"), p["alias"])), ",").alias("places"))


@query(O + ", s AS (SELECT chapter, scene, alias, left(alias, 1) AS canonical FROM o WHERE scene % 2 = 0), g AS (SELECT chapter, scene, alias, CASE WHEN canonical < 'm' THEN 'low' ELSE canonical END AS canonical FROM s), a AS (SELECT chapter, scene, alias, 'new' AS canonical FROM o WHERE scene % 4 = 0 OR scene % 5 = 0), f AS (SELECT * FROM a UNION ALL SELECT * FROM g WHERE (chapter, scene, alias) NOT IN (SELECT (chapter, scene, alias) FROM a)), u AS (SELECT chapter, scene, alias FROM o WHERE scene % 3 = 0 AND (chapter, scene, alias) NOT IN (SELECT (chapter, scene, alias) FROM f)) SELECT 'occurrences' AS part, canonical AS name, count(*) AS n FROM f GROUP BY canonical UNION ALL SELECT 'unresolved', '', count(*) FROM u UNION ALL SELECT 'registry', name, 1 FROM (SELECT DISTINCT left(alias, 1) AS name FROM o WHERE NOT left(alias, 1) < 'm' UNION SELECT 'low')")
def alias_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch's merges, assignments and open aliases applied to what was known."""
    rows = occurrences(spark, sf_dir)
    first = rows.withColumn("canonical", F.substring("alias", 1, 1))
    names = first.select("canonical").distinct()
    entry = lambda df: df.select("canonical", F.array().cast("array<string>").alias("candidates"))
    state = {"registry": entry(names), "occurrences": first.where("scene % 2 = 0"), "unresolved": rows.where("scene % 3 = 0").withColumn("reason", F.lit("?"))}
    update = {"characters": entry(spark.createDataFrame([("low",)], "canonical string")), "merges": names.where("canonical < 'm'").select(F.col("canonical").alias("absorb"), F.lit("low").alias("keep")), "assignments": rows.where("scene % 4 = 0 OR scene % 5 = 0").withColumn("canonical", F.lit("new")), "unresolved": rows.limit(0).withColumn("reason", F.lit("?"))}
    after = entities.apply_batch(state, update)
    held = after["occurrences"].groupBy(F.col("canonical").alias("name")).count().select(F.lit("occurrences").alias("part"), "name", F.col("count").alias("n"))
    open_ = after["unresolved"].agg(F.count("*").alias("n")).select(F.lit("unresolved"), F.lit(""), "n")
    return held.union(open_).union(after["registry"].select(F.lit("registry"), "canonical", F.lit(1).cast("long")))


LINES = "WITH d AS (SELECT doc_id, trim(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) AS t FROM documents), l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, unnest(range(len(string_split(t, chr(10))))) AS line FROM d), s AS (SELECT *, trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13) || chr(160)) AS y FROM l), h AS (SELECT *, regexp_extract(y, '^(#{1,6})\\s+(.*\\S)\\s*$', 2) AS hd FROM s), k AS (SELECT *, CASE WHEN hd <> '' THEN hd ELSE y END AS shown FROM h), b AS (SELECT *, trim(shown, '# ' || chr(9) || chr(11) || chr(12) || chr(13) || chr(160)) AS bare FROM k), q AS (SELECT *, bare <> '' AND len(bare) <= 120 AND regexp_matches(bare, '^[A-F][a-z]+ ') AS head FROM b), g AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY line) AS section FROM q)"


@query(LINES + ", c AS (SELECT doc_id, section, min(line) AS line, trim(coalesce(string_agg(x, chr(10) ORDER BY line) FILTER (WHERE NOT head), ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) AS content, max(section) OVER (PARTITION BY doc_id) AS most FROM g GROUP BY doc_id, section), r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS index, 'line:' || (line + 1) AS path, content FROM c WHERE content <> '' AND most > 0), w AS (SELECT doc_id, 0 AS index, '' AS path, t AS content FROM d WHERE doc_id NOT IN (SELECT doc_id FROM r)) SELECT doc_id, index, path, len(content) AS n, md5(content) AS digest FROM (SELECT * FROM r UNION ALL SELECT * FROM w)")
def line_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut at lines that begin with a word of certain capitals."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), T.normalize_text(F.col("text")).alias("text"))
    rows = books.split_text(texts, r"^[A-F][a-z]+ ")
    return rows.select(F.col("doc").alias("doc_id"), F.col("index").cast("long").alias("index"), "path", F.length("content").cast("long").alias("n"), F.md5("content").alias("digest"))


@query("WITH n AS (SELECT conv_id, turn, lower(regexp_extract(text, '([A-Za-z]+)', 1)) AS name FROM conversations), s AS (SELECT DISTINCT turn AS scene FROM n), u AS (SELECT turn AS scene, left(name, 1) AS speaker, max(name) AS name FROM n GROUP BY ALL), g AS (SELECT s.scene, p.speaker, u.name FROM s, (SELECT DISTINCT speaker FROM u) p LEFT JOIN u ON u.scene = s.scene AND u.speaker = p.speaker), w AS (SELECT scene, speaker, last_value(name IGNORE NULLS) OVER (PARTITION BY speaker ORDER BY scene ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS name FROM g) SELECT * FROM w WHERE name IS NOT NULL")
def speaker_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last name given to each speaker up to each scene."""
    rows = occurrences(spark, sf_dir).select("scene", F.substring("alias", 1, 1).alias("speaker"), F.col("alias").alias("name"))
    return scenes.with_speaker_names(rows, rows).select("scene", "speaker", "name")


def scenes_of(spark: SparkSession, sf_dir: str, rest: int) -> DataFrame:
    """Vectors as scenes of a source of each label: the even ones are one telling, the odd ones the other."""
    return embeddings(spark, sf_dir).where(F.col("id") % 2 == rest).select(F.col("label").alias("key"), "id", F.col("id").alias("order"), "v")


@query(E + """, p AS (SELECT label AS key, id, v, id % 2 AS side, row_number() OVER (PARTITION BY label, id % 2 ORDER BY id) - 1 AS place, count(*) OVER (PARTITION BY label, id % 2) AS size FROM u),
    c AS (SELECT a.key, a.id AS "left", b.id AS "right", round(list_inner_product(a.v, b.v), 9) AS sim, floor(a.place * b.size / a.size) AS middle, b.place FROM p a JOIN p b ON a.key = b.key AND a.side = 0 AND b.side = 1)
    SELECT key, "left", "right", round(sim, 6) AS sim FROM c WHERE sim > 0.05 AND place BETWEEN middle - 5 AND middle + 5""")  # fmt: skip
def align_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes of two tellings that are alike and stand near the same part of the story."""
    found = search.align(scenes_of(spark, sf_dir, 0), scenes_of(spark, sf_dir, 1), 0.05, 5)["candidates"]
    return found.withColumn("sim", F.round("sim", 6))


@query()
def align_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best monotone chain of them: equal to the full table in the tests."""
    return search.align(scenes_of(spark, sf_dir, 0), scenes_of(spark, sf_dir, 1), 0.05, 5)["links"].withColumn("sim", F.round("sim", 6))


@query()
def density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of mutual reachability: equal to a plain version in the tests."""
    return density.clusters(embeddings(spark, sf_dir).select("id", "v"), 5)


def sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as short sounds of 64 samples a second."""
    return embeddings(spark, sf_dir).select("id", "label", F.lit(64).alias("rate"), F.col("v").alias("samples"))


_LOUD = "list_filter(range(0, 5), lambda k: {at} >= 0 AND {at} <= 64 AND list_avg(list_transform(list_slice(s, greatest(0, {at} - 4) + 1, least(64, {at} + 4)), lambda x: abs(x))) >= bar)"
_LEFT, _RIGHT = _LOUD.format(at="(a - 4 * k)"), _LOUD.format(at="(b + 4 * k)")


@query(f"""WITH p AS (SELECT vec_id AS id, embedding::DOUBLE[] AS s, (vec_id % 30)::INT AS a, (vec_id % 30 + 1 + vec_id % 33)::INT AS b FROM embeddings), q AS (SELECT *, greatest(0.004, 0.08 * 5 * list_max(list_transform(s, lambda x: abs(x)))) AS bar FROM p),
    f AS (SELECT id, a, b, coalesce(a - 4 * ({_LEFT})[1], a) AS x, coalesce(b + 4 * ({_RIGHT})[1], b) AS y FROM q)
    SELECT id, CASE WHEN y > x THEN x ELSE a END::INT AS snapped_start, CASE WHEN y > x THEN y ELSE b END::INT AS snapped_end FROM f""")  # fmt: skip
def energy_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a sound whose ends move to where it is loud, every 4 samples up to 16 of them; the sound five times as loud."""
    louder = F.transform("samples", lambda x: x * 5)
    rows = sounds(spark, sf_dir).select("id", "samples", (F.col("id") % 30).cast("int").alias("start"), (F.col("id") % 30 + 1 + F.col("id") % 33).cast("int").alias("end"))
    floor = signals.amplitude_floor(louder)
    x, y = (signals.energy_snap(F.col("samples"), F.col(c), left, 16, floor, 4) for c, left in (("start", True), ("end", False)))
    fine = y > x
    return rows.select("id", F.when(fine, x).otherwise(F.col("start")).alias("snapped_start"), F.when(fine, y).otherwise(F.col("end")).alias("snapped_end"))


@query("WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v, (vec_id % 10) / 20 AS share FROM embeddings) SELECT id FROM e WHERE 20 * log10(sqrt(list_inner_product(v, v) / len(v)) + 1e-9) >= -18.1 AND share <= 0.15")
def voice_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sounds loud enough, and little enough of them speech, to be told as vocal sounds."""
    rows = sounds(spark, sf_dir).withColumn("speech_share", (F.col("id") % 10) / 20)
    return rows.where(signals.voice_gate(rows, -18.1)).select("id")


@query()
def sound_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key, tempo, energy and brightness of each sound: known signals in the tests."""
    rows = signals.music_features(sounds(spark, sf_dir))
    return rows.select("id", "bpm", "key_centre", F.round("energy", 6).alias("energy"), F.round("brightness", 6).alias("brightness"))


@query()
def sound_prosody(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals.prosody(sounds(spark, sf_dir))
    return rows.select("id", "onsets", F.round("db", 6).alias("db"), F.size("voiced").alias("n_voiced"), "volume", "speech_rate", "pitch")


@query(E + """, d AS (SELECT id, label, raw, lag(raw) OVER (PARTITION BY label ORDER BY id) AS p FROM e), c AS (SELECT id, label, round(CASE WHEN p IS NULL THEN 0 ELSE list_sum(list_transform(list_zip(raw, p), lambda z: abs(z[1] - z[2]))) / 64 END, 9) AS change FROM d),
    m AS (SELECT *, (sum(change) OVER w - change) / greatest(count(*) OVER w - 1, 1) AS mean FROM c WINDOW w AS (PARTITION BY label ORDER BY id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
    SELECT label AS video, id AS frame, round(change, 6) AS change, round(round(CASE WHEN mean > 1e-9 THEN change / mean WHEN change > 1e-9 THEN 255 ELSE 0 END, 9), 6) AS ratio FROM m""")  # fmt: skip
def frame_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as frames of a video of each label: how much each differs from the one before, and from its neighbours' changes."""
    rows = signals.frame_changes(embeddings(spark, sf_dir).select(F.col("label").alias("video"), F.col("id").alias("frame"), "v"))
    return rows.select("video", "frame", F.round("change", 6).alias("change"), F.round("ratio", 6).alias("ratio"))


@query("WITH RECURSIVE " + E[5:] + """, d AS (SELECT id, label, raw, lag(raw) OVER (PARTITION BY label ORDER BY id) AS p FROM e), c AS (SELECT id, label, round(CASE WHEN p IS NULL THEN 0 ELSE list_sum(list_transform(list_zip(raw, p), lambda z: abs(z[1] - z[2]))) / 64 END, 9) AS change FROM d),
    m AS (SELECT *, (sum(change) OVER w - change) / greatest(count(*) OVER w - 1, 1) AS mean FROM c WINDOW w AS (PARTITION BY label ORDER BY id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
    k AS (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY id) AS k FROM m WHERE mean > 1e-9 AND round(change / mean, 9) >= 1.05 AND change >= 0.12),
    n AS (SELECT label, min(id) AS first, max(id) + 1 AS last FROM e GROUP BY label),
    w AS (SELECT label, 0::BIGINT AS k, first AS id, first AS upto, true AS cut FROM n
          UNION ALL SELECT k.label, k.k, k.id, CASE WHEN k.id - w.upto >= 40 THEN k.id ELSE w.upto END, k.id - w.upto >= 40 FROM w JOIN k ON k.label = w.label AND k.k = w.k + 1)
    SELECT label AS video, 'sh' || lpad(row_number() OVER (PARTITION BY label ORDER BY id)::VARCHAR, 3, '0') AS shot_id, id::BIGINT AS start_frame, coalesce(lead(id) OVER (PARTITION BY label ORDER BY id), last)::BIGINT AS end_frame FROM w JOIN n USING (label) WHERE cut""")  # fmt: skip
def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir).select(F.col("label").alias("video"), F.col("id").alias("frame"), "v")
    return signals.shots(rows, 1.05, 0.12, 40)


@query("WITH w AS (SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN 'new' ELSE 'old' END AS model FROM embeddings) SELECT count(*) AS wanted, count(*) FILTER (WHERE id % 3 <> 0 OR model = 'new') AS computed, count(*) AS valid FROM w")
def cached_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache that holds a third of the vectors, made by a model that a fifth of all rows no longer use: what is computed, and what is valid afterwards."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("key"), "vec_id", "embedding")
    signed = lambda model: rows.withColumn("signature", caches.signature(F.col("embedding").cast("string"), model))
    cache = caches.Cache(spark, f"{folder_of(spark)}/cache-{uuid.uuid4().hex}")
    made = lambda df: df.select("key", "signature", F.col("embedding").alias("value"))
    cache.add(made(signed(F.lit("old")).where("vec_id % 3 = 0")))
    wanted = signed(F.when(F.col("vec_id") % 5 == 0, "new").otherwise("old"))
    before = cache.missing(wanted).count()
    valid = cache.filled(wanted, made)
    return valid.agg(F.count("*").alias("valid")).select(F.lit(wanted.count()).cast("long").alias("wanted"), F.lit(before).cast("long").alias("computed"), "valid")


@query(E + """, p AS (SELECT label::VARCHAR AS name, id % 2 AS half, i, avg(v[i]) AS x FROM u, range(1, 65) r(i) GROUP BY label, id % 2, i), d AS (SELECT name, half, list(x ORDER BY i) AS c FROM p GROUP BY name, half),
    old AS (SELECT name, c, row_number() OVER (ORDER BY name) - 1 AS speaker FROM d WHERE half = 0),
    s AS (SELECT d.name, old.speaker, round(list_inner_product(d.c, old.c) / (greatest(sqrt(list_inner_product(d.c, d.c)), 1e-10) * greatest(sqrt(list_inner_product(old.c, old.c)), 1e-10)), 9) AS sim FROM d, old WHERE half = 1),
    b AS (SELECT name, max(sim) AS sim, arg_max(speaker, (sim, -speaker)) AS speaker FROM s WHERE sim >= 0.18 GROUP BY name),
    n AS (SELECT name, row_number() OVER (ORDER BY name) - 1 + (SELECT count(*) FROM old) AS speaker FROM d WHERE half = 1 AND name NOT IN (SELECT name FROM b)),
    every AS (SELECT 'first' AS key, name, speaker, NULL::DOUBLE AS sim FROM old UNION ALL SELECT 'second', name, speaker, sim FROM b UNION ALL SELECT 'second', name, speaker, NULL FROM n)
    SELECT key, name AS local, speaker::BIGINT AS speaker, printf('SPKR_%03d', speaker::BIGINT) AS name, round(sim, 6) AS sim FROM every""")  # fmt: skip
def speaker_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as speakers: those of the even vectors are a first recording, which fills a bank, and those of the odd ones a second, recognised by it."""
    rows = embeddings(spark, sf_dir).where("v IS NOT NULL AND label IS NOT NULL").select("id", F.col("label").cast("string").alias("speaker"), "v")
    bank = speakers.SpeakerBank(spark, f"{folder_of(spark)}/bank-{uuid.uuid4().hex}", "sample")
    told = []
    for half, key in enumerate(["first", "second"]):
        mine = rows.where(F.col("id") % 2 == half).withColumn("key", F.lit(key))
        told.append(bank.recognise(mine.select("key", "speaker", F.col("id").cast("double").alias("start")), mine.select("key", "speaker", "v"), 0.18))
    return told[0].unionByName(told[1]).withColumn("sim", F.round("sim", 6))


@query(I + """, b AS (SELECT key, id % 3 AS grp, s, e, label FROM t), a AS (SELECT key, id % 3 AS grp, s + (id % 7) / 10 AS s, e, label FROM t WHERE id % 11 <> 0),
    bk AS (SELECT *, row_number() OVER w AS k FROM b WINDOW w AS (PARTITION BY key, grp ORDER BY s, e, label)), ak AS (SELECT *, row_number() OVER w AS k FROM a WINDOW w AS (PARTITION BY key, grp ORDER BY s, e, label)),
    m AS (SELECT bk.key, bk.grp, count(*) AS nb, count(ak.k) AS na, max(greatest(abs(ak.s - bk.s), abs(ak.e - bk.e))) AS moved FROM bk LEFT JOIN ak ON ak.key = bk.key AND ak.grp = bk.grp AND ak.k = bk.k GROUP BY bk.key, bk.grp)
    SELECT key, grp, nb AS n_before, na AS n_after, CASE WHEN nb = na THEN round(moved, 3) END AS moved FROM m""")  # fmt: skip
def alignment_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as entries, by thirds of a user's; aligned ones start up to 0.6 seconds later, and one of eleven is lost."""
    before = timeline(spark, sf_dir).withColumn("grp", F.col("id") % 3).withColumn("text", F.col("label"))
    after = before.where("id % 11 <> 0").withColumn("start", F.col("start") + (F.col("id") % 7) / 10)
    out = transcript.alignment_diagnostics(before.select("key", "grp").distinct(), before, after)
    return out.select("key", "grp", "n_before", "n_after", "moved")


@query(I + """, a AS (SELECT *, sum((lag IS DISTINCT FROM label)::INT) OVER (PARTITION BY key ORDER BY s, id) AS turn FROM (SELECT *, lag(label) OVER (PARTITION BY key ORDER BY s, id) AS lag FROM t)),
    b AS (SELECT *, max(e) OVER (PARTITION BY key, turn ORDER BY s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM a),
    c AS (SELECT *, sum((reach IS NULL OR s - reach > 21600)::INT) OVER (PARTITION BY key, turn ORDER BY s, id) AS part FROM b)
    SELECT key, any_value(label) AS label, round(min(s), 3) AS start, round(max(e), 3) AS "end", count(*) AS n FROM c GROUP BY key, turn, part""")  # fmt: skip
def sound_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and what else happened as the events of two detectors."""
    return intervals.sound_timeline(*_two(spark, sf_dir), 6 * HOUR).select("key", "label", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "n")


@query()
def speech_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rescue and the repair after it in one: a fold, checked against brute force in the tests."""
    rows = timeline(spark, sf_dir).withColumn("quality", (F.col("id") % 100) / 100)
    totals = rows.groupBy("key").agg(F.max("end").alias("total"))
    return intervals.with_rescued(rows.where("label = 'purchase'"), rows.where("label = 'click'"), totals, 600.0)


@query(I + """, shot AS (SELECT DISTINCT key, floor(s / 14400) AS shot FROM t), l AS (SELECT key, s, e, id % 3 AS part,
        CASE id % 3 WHEN 0 THEN '  ' || label || ': "' || id::VARCHAR || '"' || CASE WHEN id % 2 = 0 THEN ' [calm]' ELSE '' END
            WHEN 1 THEN '  [' || label || '] ' || id::VARCHAR || ' (' || printf('%.1f', s) || 's-' || printf('%.1f', e) || 's)'
            ELSE '  [' || label || ']' || CASE WHEN id % 2 = 0 THEN ' mood: calm' ELSE '' END END AS line FROM t),
    m AS (SELECT shot.key, shot, part, string_agg(line, chr(10) ORDER BY s, e, line) AS lines FROM shot JOIN l ON l.key = shot.key AND CASE WHEN part = 2 THEN e > shot * 14400 AND s < shot * 14400 + 14400 ELSE s >= shot * 14400 AND e <= shot * 14400 + 14400 END GROUP BY ALL),
    g AS (SELECT key, shot, string_agg(CASE part WHEN 0 THEN 'Dialogue:' WHEN 1 THEN 'Sounds:' ELSE 'Music:' END || chr(10) || lines, chr(10) ORDER BY part) AS summary FROM m GROUP BY key, shot)
    SELECT shot.key AS video, shot.shot::BIGINT AS shot_id, coalesce(summary, '[No significant audio]') AS summary FROM shot LEFT JOIN g ON g.key = shot.key AND g.shot = shot.shot""")  # fmt: skip
def shot_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of four hours as shots; events are dialogue, sounds and music by thirds."""
    rows = timeline(spark, sf_dir).withColumn("text", F.col("id").cast("string")).withColumn("calm", F.when(F.col("id") % 2 == 0, "calm"))
    shots_ = rows.select(F.col("key").alias("video"), F.floor(F.col("start") / (4 * HOUR)).alias("shot_id")).distinct().withColumn("start", F.col("shot_id") * 4 * HOUR).withColumn("end", F.col("start") + 4 * HOUR)
    part = lambda k, *more: rows.where(F.col("id") % 3 == k).select(F.col("key").alias("video"), "start", "end", *more)
    said, sound = part(0, F.col("label").alias("speaker"), "text", F.col("calm").alias("emotion")), part(1, F.col("label").alias("kind"), F.col("text").alias("description"))
    return scenes.shot_audio(shots_, said, sound, part(2, F.col("label").alias("kind"), F.col("calm").alias("mood"), F.lit(None).cast("string").alias("instruments")), 4 * HOUR)
