"""Views that give the supplied tables the shapes of site, interval, depth and track tables.

The text of each view is SQL for Spark and for DuckDB; {SECS} is the seconds
since 2024 began, which the two write differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources import stored

SPARK_SECS = "timestampdiff(SECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)"
DUCK_SECS = "date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts)"

SITE_ROWS = """SELECT concat('chr', CAST(l_suppkey % 22 + 1 AS STRING)) AS chr,
         CAST(l_orderkey*100 + l_linenumber*10 + l_partkey % 10 AS INT) AS pos,
         substr('ACGT', CAST(l_partkey % 4 + 1 AS INT), 1) AS refnt,
         CASE WHEN l_linestatus='F' THEN substr('ACGT', CAST((l_partkey + 1 + l_linenumber % 3) % 4 + 1 AS INT), 1)
              ELSE concat(substr('ACGT', CAST(l_partkey % 4 + 1 AS INT), 1), 'T') END AS altnt,
         CAST(l_quantity AS INT) AS dp,
         CAST(floor(CAST(l_quantity AS INT) * CAST(round(l_discount*100) AS INT) / 10.0) AS INT) AS scalt,
         CAST(l_partkey % 40 AS INT) AS bulk_dp,
         CAST(CASE WHEN l_partkey % 7 = 0 THEN least(l_partkey % 40, l_partkey % 5) ELSE 0 END AS INT) AS balt,
         CASE WHEN l_suppkey % 10 = 0 THEN concat('rs', CAST(l_partkey AS STRING)) ELSE '.' END AS dbsnp,
         CASE WHEN l_returnflag='R' THEN CASE WHEN l_orderkey % 2 = 0 THEN '0|1' ELSE '1|0' END
              WHEN l_returnflag='A' THEN './.' END AS phased_gt,
         nullif(CAST(l_suppkey % 4 AS INT), 0) AS unique_donors, CAST(l_linenumber % 4 AS INT) AS unique_cells,
         CAST(l_linenumber AS INT) AS max_out
  FROM lineitem"""
SITE = f"""
SELECT chr, pos, refnt, altnt, max(dp) AS dp, least(max(scalt), max(dp)) AS scalt, max(bulk_dp) AS bulk_dp,
       least(max(balt), max(bulk_dp)) AS balt, min(dbsnp) AS dbsnp, max(phased_gt) AS phased_gt,
       max(unique_donors) AS unique_donors, max(unique_cells) AS unique_cells, max(max_out) AS max_out
FROM ({SITE_ROWS}) b
GROUP BY chr, pos, refnt, altnt"""
SAMPLE_COUNTS = """
SELECT concat('chr', CAST(l_suppkey % 22 + 1 AS STRING)) AS chr, CAST(l_orderkey AS INT) AS pos,
       concat(l_returnflag, l_linestatus) AS sample,
       CAST(sum(CAST(l_quantity AS INT)) AS INT) AS ref_n,
       CAST(sum(CAST(round(l_discount*100) AS INT)) AS INT) AS alt_n
FROM lineitem GROUP BY 1, 2, 3"""
DEPTH = "SELECT CAST(l_quantity AS INT) AS sc_dp, CAST(l_partkey % 40 AS INT) AS bulk_dp, l_returnflag AS chr_group FROM lineitem"
TRACK = "SELECT event_type AS chr, CAST({SECS} AS INT) AS pos, event_id, user_id, value FROM events"
BINS = f"""
SELECT chr, CAST(floor(pos/3600.0) AS INT)*3600 + 1 AS start, CAST(floor(pos/3600.0) AS INT)*3600 + 3600 AS end_,
       count(*) AS cnt, round(avg(value)/500, 6) AS gc FROM ({TRACK}) t GROUP BY 1, 2, 3"""
INTERVAL = """
SELECT concat('chr', CAST(o_custkey % 22 + 1 AS STRING)) AS chr, CAST(o_orderkey*10 + 1 AS INT) AS start,
       CAST(o_orderkey*10 + 2 + o_custkey % 400 AS INT) AS end_ FROM orders"""
VIEWS = {"site": (SITE, "lineitem"), "sample_counts": (SAMPLE_COUNTS, "lineitem"), "depth": (DEPTH, "lineitem"), "track": (TRACK, "events"), "bins": (BINS, "events"), "interval": (INTERVAL, "orders")}

#: Of views that group rows by place: the rows, and the groups.
_ROWS = {"site": SITE_ROWS, "sample_counts": "SELECT concat('chr', CAST(l_suppkey % 22 + 1 AS STRING)) AS chr, CAST(l_orderkey AS INT) AS pos, concat(l_returnflag, l_linestatus) AS sample, l_quantity, l_discount FROM lineitem"}
_GROUPS = {"site": SITE.replace(SITE_ROWS, "SELECT * FROM {rows}"), "sample_counts": SAMPLE_COUNTS.replace("concat('chr', CAST(l_suppkey % 22 + 1 AS STRING)) AS chr, CAST(l_orderkey AS INT) AS pos", "chr, pos").replace("concat(l_returnflag, l_linestatus) AS sample", "sample").replace("FROM lineitem GROUP BY 1, 2, 3", "FROM {rows} GROUP BY chr, pos, sample")}


def view(spark: SparkSession, sf_dir: str, name: str, wide: bool = False) -> DataFrame:
    """A view's rows.

    Those of a place are grouped where they have been dealt to: before, next to none
    have one in common.  Groups are sorted by position first, which tells most apart.
    ``wide``: positions of sites have 64 bits, for tables whose order keys take them
    beyond the 32 bits of the view's SQL (from about 21 million on).
    """
    text, base = VIEWS[name]
    if name in _ROWS:
        text = _ROWS[name].replace("% 10 AS INT) AS pos", "% 10 AS BIGINT) AS pos") if wide else _ROWS[name]
        rows = spark.sql(text.replace(f"FROM {base}", "FROM {base}"), base=spark.read.parquet(f"{sf_dir}/{base}.parquet"))
        return spark.sql(_GROUPS[name].replace("GROUP BY chr, pos", "GROUP BY pos, chr"), rows=stored.dealt(rows, "chr", "pos"))
    text = text.replace("{SECS}", SPARK_SECS).replace(f"FROM {base}", "FROM {base}")
    return spark.sql(text, base=spark.read.parquet(f"{sf_dir}/{base}.parquet"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def duck(*names: str) -> str:
    """The views as the beginning of a WITH clause for DuckDB."""
    return ", ".join(f"{n}_v AS ({VIEWS[n][0].replace('{SECS}', DUCK_SECS)})" for n in names)

#: Site rows with the columns of later stages, filled by arithmetic of the counts.
SCORED = """
SELECT chr, pos, refnt, altnt, dp, scalt, dp - scalt AS scref, bulk_dp, balt, bulk_dp - balt AS bref, dbsnp, phased_gt, unique_donors, unique_cells, max_out,
       CASE WHEN length(refnt) = 1 AND length(altnt) = 1 THEN 'snv' ELSE 'indel' END AS muttype,
       concat(refnt, '>', altnt) AS channel, CASE WHEN length(altnt) = 2 THEN CASE pos % 11 WHEN 0 THEN '1:Ins:C:3' WHEN 1 THEN '1:Ins:T:5' WHEN 2 THEN '2:Ins:R:2' WHEN 3 THEN '1:Ins:C:2' END END AS mutsig,
       CAST(pos % 4 AS INT) AS id_n, CAST(pos % 3 AS INT) AS hs_n, dp AS cigar_dp, balt AS id_n_bulk, CAST(pos % 2 AS INT) AS hs_n_bulk, bulk_dp AS cigar_dp_bulk,
       scalt / nullif(CAST(dp AS DOUBLE), 0) AS af, balt / nullif(CAST(bulk_dp AS DOUBLE), 0) AS bulk_af,
       CASE WHEN bulk_dp > 0 THEN (balt + 1) / CAST(bulk_dp + 1 AS DOUBLE) END AS bulk_binom_prob,
       CASE WHEN pos % 3 = 0 THEN balt END AS balt_lowmq, CASE WHEN balt = 0 THEN '0/0' ELSE '0/1' END AS bulk_gt,
       CAST(scalt + pos % 2 AS INT) AS talt, CAST(pos % 5 AS INT) AS tcells,
       coalesce(phased_gt IN ('0|1', '1|0'), false) AS training_site,
       CAST(dp % 20 AS DOUBLE) / 20 AS abc_pv, CAST(pos % 17 AS DOUBLE) / 17 AS id_score, CAST(pos % 13 AS DOUBLE) / 13 AS hs_score,
       CAST((scalt * 7 + dp) % 100 + 1 AS DOUBLE) / 101 AS lysis_pv, CAST((scalt * 3 + dp) % 50 + 1 AS DOUBLE) / 51 AS lysis_beta,
       CAST((scalt * 5 + dp) % 100 + 1 AS DOUBLE) / 101 AS mda_pv, CAST((scalt + dp) % 50 + 1 AS DOUBLE) / 51 AS mda_beta,
       CAST(1 + dp % 9 AS DOUBLE) * 20 AS nt, CAST(1 + scalt % 3 AS DOUBLE) / 4 AS na
FROM site_v"""


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel columns of all sites, before alleles are put together: enough for their maxima."""
    return table(spark, sf_dir, "lineitem").selectExpr("nullif(cast(l_suppkey % 4 as int), 0) as unique_donors", "cast(l_linenumber % 4 as int) as unique_cells")


def scored(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    return spark.sql(SCORED.replace("FROM site_v", "FROM {site}"), site=view(spark, sf_dir, "site", wide))


def duck_scored(*more: str) -> str:
    return duck("site", *more) + f", scored AS ({SCORED})"
