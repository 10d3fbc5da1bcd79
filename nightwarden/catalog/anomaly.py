"""Queries over anomaly scoring (E*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomaly as an
from ..schema import with_micros
from ..session import cut_lineage
from .detectors import FAILED, SUCCESS
from .fixture import events, with_ev
from .registry import query

FEATURES_SQL = f"""
f AS (SELECT seq, CAST(hour(ts) AS DOUBLE) AS hour_of_day, CAST(isodow(ts) >= 6 AS DOUBLE) AS is_weekend,
  CAST(coalesce({FAILED}, false) AS DOUBLE) AS is_failed, CAST(coalesce({SUCCESS}, false) AS DOUBLE) AS is_success,
  CAST(coalesce(logon_type, 0) AS DOUBLE) AS logon_type, CAST(1 AS DOUBLE) AS has_source_ip,
  CAST(starts_with(source_ip, '10.') AS DOUBLE) AS is_private_ip,
  CAST(coalesce(regexp_matches(lower(process_name), '(^|\\\\)(cmd|certutil)\\.exe$'), false) AS DOUBLE) AS process_suspicious,
  CAST(CASE WHEN event_id IS NULL THEN 0 WHEN event_id = 4625 THEN 2 WHEN event_id BETWEEN 4624 AND 4629 THEN 1
    WHEN event_id = 4688 THEN 3 WHEN event_id BETWEEN 4698 AND 4702 THEN 4 WHEN event_id BETWEEN 4720 AND 4729 THEN 5
    ELSE 8 END AS DOUBLE) AS event_id_bucket,
  CAST(command_line IS NOT NULL AS DOUBLE) AS has_command_line FROM ev)"""


@query("anomaly_features", with_ev(FEATURES_SQL, select="SELECT * FROM f"))
def anomaly_features(spark, sf_dir):
    """The ten features of every event."""
    return an.features(events(spark, sf_dir))


@query("anomaly_scaled", with_ev(FEATURES_SQL, f"""
m AS (SELECT {", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS d_{f}" for f in an.FEATURES)} FROM f)""",
    select="SELECT seq, " + ", ".join(
        f"round(CASE WHEN d_{f} > 1e-9 THEN ({f} - m_{f}) / d_{f} ELSE 0.0 END, 4) + 0.0 AS {f}" for f in an.FEATURES)
    + " FROM f, m"))
def anomaly_scaled(spark, sf_dir):
    """Features with zero mean and unit deviation."""
    return an.scale(an.features(events(spark, sf_dir))).select(
        "seq", *[(F.round(f, 4) + 0.0).alias(f) for f in an.FEATURES])


SCORE_SQL = "round(-(k + 1) / 250.0, 4)"


def _scored(spark, sf_dir):
    """Events with a score that follows from k, so that bands and texts can be compared exactly."""
    k = F.substring_index(F.element_at("raw", F.lit("TaskName")), "\\", -1).cast("int")
    return with_micros(events(spark, sf_dir)).withColumn("score", F.round(-(k + 1) / F.lit(250.0), 4))


@query("anomaly_bands", with_ev(f"s AS (SELECT seq, {SCORE_SQL} AS raw_score, k FROM ev)",
       "o AS (SELECT quantile_cont(raw_score, 0.05) AS off FROM s)",
       select="""
SELECT severity, count(*) AS n, round(min(score), 4) AS lo, round(max(score), 4) AS hi FROM (
  SELECT raw_score + 0.2 AS score, CASE WHEN raw_score + 0.2 >= -0.05 THEN 'normal' WHEN raw_score + 0.2 < -0.2 THEN 'high'
    WHEN raw_score + 0.2 < -0.12 THEN 'medium' ELSE 'low' END AS severity FROM s
  UNION ALL SELECT raw_score - off, CASE WHEN raw_score - off < 0 THEN 'below offset' ELSE 'above offset' END FROM s, o) GROUP BY severity"""))
def anomaly_bands(spark, sf_dir):
    """Severity bands of given scores, and how the contamination share splits them."""
    raw = _scored(spark, sf_dir).withColumnRenamed("score", "raw_score")
    shifted = raw.select((F.col("raw_score") + 0.2).alias("score"))
    banded = shifted.select("score", F.coalesce(an.band(F.col("score")), F.lit("normal")).alias("severity"))
    offset = an.with_offset(raw, 0.05, weight=None).select(
        "score", F.when(F.col("score") < 0, "below offset").otherwise("above offset").alias("severity"))
    return banded.unionByName(offset).groupBy("severity").agg(
        F.count("*").alias("n"), F.round(F.min("score"), 4).alias("lo"), F.round(F.max("score"), 4).alias("hi"))


@query("anomaly_text", with_ev(select=f"""
SELECT seq, concat_ws(' ', printf('Anomaly score %.3f (lower = more unusual).', {SCORE_SQL}), 'Host: ' || hostname || '.',
  'User: ' || username || '.', 'Source IP: ' || source_ip || '.', 'Process: ' || process_name || '.',
  'Command: ' || substr(command_line, 1, 80) || '.',
  CASE WHEN hour(ts) < 6 OR hour(ts) > 22 THEN 'Activity at unusual hour (' || lpad(CAST(hour(ts) AS VARCHAR), 2, '0') || ':00).' END,
  CASE WHEN {FAILED} THEN 'Failed authentication.' END,
  CASE logon_type WHEN 3 THEN 'Network logon type — possible lateral movement.' WHEN 10 THEN 'Remote interactive logon (RDP).' END) AS description
FROM ev"""))
def anomaly_text(spark, sf_dir):
    """The explanation of every event under a given score."""
    return _scored(spark, sf_dir).select("seq", an.describe(F.col("score")).alias("description"))


def _uniform_sql(*parts: str) -> str:
    text = " || '|' || ".join(parts)
    return f"((CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) + 0.5) / 4503599627370496)"


def _each(text: str) -> str:
    return ", ".join(text.format(i=i, f=f) for i, f in enumerate(an.FEATURES, 1))


# Every event's draw for every tree, the trees grown level by level from the smallest, and all vectors' ways down.
SAMPLES_SQL = f"""
v AS (SELECT concat_ws('|', {_each("CAST({f} AS BIGINT)")}) AS vector, [{_each("{f}")}] AS x, count(*) AS n FROM f GROUP BY ALL),
gaps AS (SELECT tree, vector, j, -ln({_uniform_sql("'42'", "tree", "vector", "j")}) / (n - j + 1) AS gap
  FROM (SELECT vector, n, unnest(range(1, least(n, {an.SAMPLE}) + 1)) AS j FROM v), range({an.TREES}) t(tree)),
times AS (SELECT tree, vector, sum(gap) OVER (PARTITION BY tree, vector ORDER BY j) AS t FROM gaps),
samples AS (SELECT tree, vector, count(*) AS drawn FROM (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY t, vector) AS rn FROM times) WHERE rn <= {an.SAMPLE} GROUP BY tree, vector)"""

SPLIT_SQL = f"""
SELECT *, low[f] + {_uniform_sql("'42'", "tree", "node", "'t'")} * (high[f] - low[f]) AS threshold FROM (
  SELECT *, CASE WHEN depth < {an.height()} AND len(may) > 0
    THEN may[1 + CAST(floor({_uniform_sql("'42'", "tree", "node", "'f'")} * len(may)) AS INTEGER)] END AS f FROM (
    SELECT *, list_filter(range(1, {len(an.FEATURES) + 1}), lambda i: high[i] > low[i]) AS may FROM (
      SELECT *, sum(drawn) OVER w AS size, [{_each("min(x[{i}]) OVER w")}] AS low, [{_each("max(x[{i}]) OVER w")}] AS high
      FROM grown WINDOW w AS (PARTITION BY tree, node))))"""

NODES_SQL = f"""
grown AS (
  SELECT tree, x, drawn, 0 AS node, 0 AS depth FROM samples JOIN v USING (vector)
  UNION ALL
  SELECT tree, x, drawn, 2 * node + CASE WHEN x[f] <= threshold THEN 1 ELSE 2 END, depth + 1
  FROM ({SPLIT_SQL}) WHERE f IS NOT NULL),
nodes AS (SELECT DISTINCT tree, node, coalesce(f - 1, -1) AS feature, coalesce(threshold, 0.0) AS threshold, size FROM ({SPLIT_SQL}))"""

SCORES_SQL = f"""
walk AS (
  SELECT tree, vector, x, n, 0 AS node, 0 AS depth FROM v, range({an.TREES}) t(tree)
  UNION ALL
  SELECT tree, vector, x, n, 2 * node + CASE WHEN x[feature + 1] <= threshold THEN 1 ELSE 2 END, depth + 1
  FROM walk JOIN nodes USING (tree, node) WHERE feature >= 0),
sized AS (SELECT *, CASE WHEN size > 2 THEN 2 * (ln(size - 1) + {an.EULER_GAMMA}) - 2 * (size - 1) / size WHEN size = 2 THEN 1
  ELSE 0 END AS path FROM nodes),
scores AS (SELECT vector, n, -pow(2, -avg(depth + path) / (SELECT avg(path) FROM sized WHERE node = 0)) AS raw_score
  FROM walk JOIN sized USING (tree, node) WHERE feature = -1 GROUP BY vector, n)"""


def _distinct(spark, sf_dir):
    found = cut_lineage(an.vectors(an.features(events(spark, sf_dir))))
    return found, found.agg(F.sum("n")).first()[0] or 0


@query("forest_samples", with_ev(FEATURES_SQL, SAMPLES_SQL, select="SELECT * FROM samples"))
def forest_samples(spark, sf_dir):
    """How many of its 256 events each tree draws from each feature vector."""
    return an.tree_samples(*_distinct(spark, sf_dir)).select("tree", an.vector_text().alias("vector"), "drawn")


@query("forest_nodes", with_ev(FEATURES_SQL, SAMPLES_SQL, NODES_SQL,
       select="SELECT tree, node, feature, round(threshold, 9) AS threshold, size FROM nodes"))
def forest_nodes(spark, sf_dir):
    """Every node of the fitted forest."""
    return an.fit(*_distinct(spark, sf_dir)).withColumn("threshold", F.round("threshold", 9))


@query("forest_scores", with_ev(FEATURES_SQL, SAMPLES_SQL, NODES_SQL, SCORES_SQL,
       select="SELECT vector, n, round(raw_score, 9) AS raw_score FROM scores"))
def forest_scores(spark, sf_dir):
    """The raw score of every feature vector."""
    distinct, total = _distinct(spark, sf_dir)
    return an.score_vectors(distinct, cut_lineage(an.fit(distinct, total))).select(
        an.vector_text().alias("vector"), "n", F.round("raw_score", 9).alias("raw_score"))


@query("isolation_forest", with_ev(FEATURES_SQL, SAMPLES_SQL, NODES_SQL, SCORES_SQL, f"""
raws AS (SELECT ev.event_id, raw_score FROM f JOIN ev USING (seq)
  JOIN scores ON vector = concat_ws('|', {_each("CAST(f.{f} AS BIGINT)")})),
shifted AS (SELECT event_id, raw_score - (SELECT quantile_cont(raw_score, 0.05) FROM raws) AS score FROM raws)""", select=f"""
SELECT CASE WHEN score >= {an.NORMAL_FROM} THEN 'normal' WHEN score < {an.HIGH_BELOW} THEN 'high'
  WHEN score < {an.MEDIUM_BELOW} THEN 'medium' ELSE 'low' END AS severity, event_id, count(*) AS n,
  round(min(score), 4) AS lowest, round(max(score), 4) AS highest FROM shifted GROUP BY ALL"""))
def isolation_forest(spark, sf_dir):
    """Scores of all events by severity band and event id."""
    scored = an.score_events(events(spark, sf_dir))
    return scored.groupBy(F.coalesce(an.band(F.col("score")), F.lit("normal")).alias("severity"), "event_id").agg(
        F.count("*").alias("n"), F.round(F.min("score"), 4).alias("lowest"), F.round(F.max("score"), 4).alias("highest"))
