"""Query catalogue: name -> (spark, sf_dir) -> DataFrame, and the same in SQL.

``events`` stands for schedules: a channel, one of three sites by priority, a start to the second, a stop that may be
missing, and the event type as title. Instants are seconds, so no session time zone matters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import config, lineups, schema
from .functions import dates, text
from .operators import fold, fusion, ingest, match, polish, registry
from .plans import guide
from .sources import xml_sink, xml_source

FIRST = 1704067200  # 2024-01-01


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt over all shuffle partitions by a unique key, before a step that costs much a row: a table may come in fewer row groups than there are cores."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def sched(spark: SparkSession, sf_dir: str, channel: str = "concat('ch', user_id % 10)", unit: int = 1) -> DataFrame:
    seconds = "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"
    st = f"cast({seconds} div {unit} * {unit} as bigint)"
    return table(spark, sf_dir, "events").selectExpr(
        f"{channel} as channel", "cast(event_id % 3 as int) as site", "event_id as seq", f"{st} as st",
        f"case when event_id % 4 <> 0 then {st} + cast(floor(value * 60) as bigint) end as sp",
        "event_type as title", f"cast(({st} - {FIRST}) div 86400 as int) as day_idx",
    )


def _sched_sql(channel: str = "'ch' || (user_id % 10)", unit: int = 1) -> str:
    st = f"(CAST(epoch(date_trunc('second', ts)) AS BIGINT) // {unit} * {unit})"
    return f"""sched AS (SELECT {channel} AS channel, CAST(event_id % 3 AS INT) AS site, event_id AS seq, {st} AS st,
      CASE WHEN event_id % 4 <> 0 THEN {st} + CAST(floor(value * 60) AS BIGINT) END AS sp, event_type AS title,
      CAST(({st} - {FIRST}) // 86400 AS INT) AS day_idx FROM events)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


# ---------------------------------------------------------------- clean-up

_NEXT = """nx AS (SELECT *, lead(st) OVER w AS l, lead(day_idx) OVER w AS ld FROM sched WINDOW w AS (PARTITION BY channel ORDER BY st, seq)),
  n AS (SELECT *, CASE WHEN ld <= day_idx + 1 THEN l END AS next_st FROM nx)"""
_FILL = "CASE WHEN sp IS NULL AND next_st > st THEN least(next_st, st + {cap}) ELSE sp END"
_CLIP = "CASE WHEN sp > next_st AND st < next_st THEN next_st ELSE sp END"


def _fill_query(name: str, cap: int, spark_channel: str | None = None, sql_channel: str | None = None):
    more = (sql_channel,) if sql_channel else ()

    @query(name, f"WITH {_sched_sql(*more)}, {_NEXT} SELECT channel, seq, st, {_FILL.format(cap=cap)} AS stop FROM n")
    def run(spark, sf_dir):
        rows = sched(spark, sf_dir, *((spark_channel,) if spark_channel else ()))
        return polish.with_next(rows).select("channel", "seq", "st", polish.filled_stop(cap).alias("stop"))


_fill_query("fill_stop", polish.CAP)
_fill_query("fill_stop_day_horizon", polish.CAP, "cast(user_id as string)", "CAST(user_id AS VARCHAR)")
_fill_query("fill_stop_cap30m", 1800)


@query("clip_overlaps", f"WITH {_sched_sql()}, {_NEXT} SELECT channel, seq, st, {_CLIP} AS stop FROM n")
def _(spark, sf_dir):
    return polish.with_next(sched(spark, sf_dir)).select("channel", "seq", "st", polish.clipped_stop().alias("stop"))


@query("polish_full", f"WITH {_sched_sql()}, {_NEXT} SELECT channel, seq, st, CASE WHEN sp IS NULL THEN {_FILL.format(cap=polish.CAP)} ELSE {_CLIP} END AS stop, title FROM n")
def _(spark, sf_dir):
    return polish.polish(polish.with_next(sched(spark, sf_dir))).selectExpr("channel", "seq", "st", "sp as stop", "title")


@query("clamp_window", f"WITH {_sched_sql()} SELECT channel, seq, st FROM sched WHERE st >= {FIRST + 5 * 86400} AND st < {FIRST + 12 * 86400}")
def _(spark, sf_dir):
    return polish.clamp(sched(spark, sf_dir), FIRST + 5 * 86400, 7).select("channel", "seq", "st")


# ---------------------------------------------------------------- channels and strategies


@query("concat_strategy", f"WITH {_sched_sql(unit=3600)} SELECT channel, site, seq, CAST(row_number() OVER (PARTITION BY channel ORDER BY st, day_idx, site, seq) AS BIGINT) AS out_seq FROM sched")
def _(spark, sf_dir):
    rows = registry.concat_order(sched(spark, sf_dir, unit=3600))
    return rows.select("channel", "site", "seq", F.col("out_seq").cast("long").alias("out_seq"))


@query("first_wins", f"WITH {_sched_sql('CAST(user_id AS VARCHAR)')} SELECT channel, site, seq FROM sched s WHERE site = (SELECT min(site) FROM sched t WHERE t.channel = s.channel)")
def _(spark, sf_dir):
    return registry.first_wins(sched(spark, sf_dir, "cast(user_id as string)")).select("channel", "site", "seq")


def _site_channels(spark, sf_dir):
    rows = sched(spark, sf_dir, "cast(user_id as string)").select(F.col("channel").alias("xmltv_id"), F.concat(F.lit("s"), "site").alias("site"), F.col("site").alias("site_rank"), F.col("channel").cast("long").alias("channel_rank"))
    return rows.distinct()


@query("keep_all_channels", f"WITH {_sched_sql('CAST(user_id AS VARCHAR)')} SELECT DISTINCT channel AS xmltv_id, 's' || site AS site FROM sched")
def _(spark, sf_dir):
    return registry.registry(_site_channels(spark, sf_dir), "keep-all").selectExpr("xmltv_id", "sources[0].site as site")


@query("channel_registry", f"WITH {_sched_sql('CAST(user_id AS VARCHAR)')}, c AS (SELECT DISTINCT channel, site FROM sched) SELECT channel AS xmltv_id, min(site) AS site_rank, string_agg('s' || site, ',' ORDER BY site) AS sites FROM c GROUP BY channel")
def _(spark, sf_dir):
    reg = registry.registry(_site_channels(spark, sf_dir))
    return reg.selectExpr("xmltv_id", "rank.site_rank as site_rank", "array_join(transform(sources, s -> s.site), ',') as sites")


@query("channel_merge_names", f"""WITH {_sched_sql()}, k AS (SELECT channel, title, min(site * 1000000 + seq % 1000000) AS o FROM sched GROUP BY channel, title)
  SELECT channel, string_agg(title, '|' ORDER BY o) AS names FROM k GROUP BY channel""")  # fmt: skip
def _(spark, sf_dir):
    names = fusion.first_seen(sched(spark, sf_dir), ["channel"], "title", F.expr("site * 1000000 + seq % 1000000"))
    return names.select("channel", F.array_join("values", "|").alias("names"))


@query("channel_element", "SELECT CAST(c_custkey AS VARCHAR) AS id, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_name END, CAST(c_custkey AS VARCHAR)) AS display_name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS icon FROM customer")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("cast(c_custkey as string) as xmltv_id", "if(c_custkey % 3 <> 0, c_name, null) as name", "if(c_custkey % 2 = 0, c_mktsegment, null) as logo")
    return rows.select(*registry.channel_element())


# ---------------------------------------------------------------- fusion

_HOUR = _sched_sql("'ch' || (user_id % 2)", 3600)


def _hourly(spark, sf_dir):
    return sched(spark, sf_dir, "concat('ch', user_id % 2)", 3600)


@query("pool_same_instant", f"WITH {_HOUR} SELECT channel, site, st, count(*) AS n, arg_min(seq, seq) AS base, arg_min(sp, seq) FILTER (sp IS NOT NULL) AS stop FROM sched GROUP BY channel, site, st")
def _(spark, sf_dir):
    rows = _hourly(spark, sf_dir).withColumn("own", F.concat_ws("/", "channel", "site"))
    # one list a channel and site: nothing to match, equal instants become one
    lists = rows.select(F.col("own").alias("channel"), F.lit(0).alias("day_idx"), F.lit(FIRST).cast("long").alias("midnight"), F.lit(0).alias("source"), "seq", F.col("seq").alias("id"), "st", "sp", F.array("title").alias("titles"))
    pooled = fold.groups(lists)
    where = F.split("channel", "/")
    return pooled.select(where[0].alias("channel"), where[1].cast("int").alias("site"), "st", F.col("n_rows").alias("n"), F.col("group_id").alias("base"), F.col("sp").alias("stop"))


_ORDER = "site * 10000000 + seq"


@query("fuse_scalars", f"WITH {_HOUR} SELECT channel, st, arg_min(sp, {_ORDER}) FILTER (sp IS NOT NULL) AS stop, arg_min(title, {_ORDER}) AS title, arg_min(seq, {_ORDER}) FILTER (seq % 5 = 0) AS fifth FROM sched GROUP BY channel, st")
def _(spark, sf_dir):
    rows = _hourly(spark, sf_dir).selectExpr("channel", "st", f"{_ORDER} as o", "sp as stop", "title as name", "if(seq % 5 = 0, seq, null) as fifth")
    fused = fusion.fuse(rows, ["channel", "st"], "o", {"stop": "bigint", "name": "string", "fifth": "bigint"})
    return fused.select("channel", "st", "stop", F.col("name").alias("title"), "fifth")


@query("fuse_union_titles", f"WITH {_HOUR}, k AS (SELECT channel, st, title, min({_ORDER}) AS o FROM sched GROUP BY channel, st, title) SELECT channel, st, string_agg(title, '|' ORDER BY o) AS titles FROM k GROUP BY channel, st")
def _(spark, sf_dir):
    titles = fusion.first_seen(_hourly(spark, sf_dir), ["channel", "st"], "title", F.expr(_ORDER))
    return titles.select("channel", "st", F.array_join("values", "|").alias("titles"))


@query("fuse_programmes", f"""WITH {_HOUR}, k AS (SELECT channel, st, title, min({_ORDER}) AS o FROM sched GROUP BY channel, st, title),
  t AS (SELECT channel, st, string_agg(title, '|' ORDER BY o) AS titles FROM k GROUP BY channel, st),
  s AS (SELECT channel, st, arg_min(sp, {_ORDER}) FILTER (sp IS NOT NULL) AS stop FROM sched GROUP BY channel, st) SELECT channel, st, titles, stop FROM t JOIN s USING (channel, st)""")  # fmt: skip
def _(spark, sf_dir):
    rows = _hourly(spark, sf_dir).withColumn("o", F.expr(_ORDER))
    texts = "array(struct(title as value, cast(null as string) as lang))"
    rows = rows.selectExpr("channel", "st", "o", "sp as stop", f"{texts} as title")
    fused = fusion.fuse(rows, ["channel", "st"], "o", {"stop": "bigint", "title": "array<struct<value: string, lang: string>>"})
    return fused.selectExpr("channel", "st", "array_join(transform(title, t -> t.value), '|') as titles", "stop")


@query("fuse_maps", """WITH a AS (SELECT p_partkey, 'brand' AS k, p_brand AS v, 0 AS r FROM part UNION ALL SELECT p_partkey, 'size', CAST(p_size AS VARCHAR), 0 FROM part
  UNION ALL SELECT p_partkey, 'size', 'other', 1 FROM part UNION ALL SELECT p_partkey, 'type', p_type, 1 FROM part), b AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, k ORDER BY r) AS n FROM a)
  SELECT p_partkey, k, v FROM b WHERE n = 1""")  # fmt: skip
def _(spark, sf_dir):
    base, extra = "map('brand', p_brand, 'size', cast(p_size as string))", "map('size', 'other', 'type', p_type)"
    merged = fusion.merge_maps(F.expr(base), F.expr(extra))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(merged).alias("k", "v"))


# ---------------------------------------------------------------- matching

_PAIR = """a AS (SELECT channel, seq AS id, st, sp, title FROM sched WHERE site = 0), b AS (SELECT channel, seq AS id, st, sp, title FROM sched WHERE site = 1),
  j AS (SELECT channel, a.id AS a_id, b.id AS b_id, a.st AS a_st, b.st AS b_st, a.sp AS a_sp, b.sp AS b_sp, a.title AS a_title, b.title AS b_title, abs(a.st - b.st) AS shift FROM a JOIN b USING (channel)
  WHERE abs(a.st - b.st) <= {tol})"""
_GUARD = "shift < least(CASE WHEN a_sp > a_st THEN a_sp - a_st ELSE 1152921504606846976 END, CASE WHEN b_sp > b_st THEN b_sp - b_st ELSE 1152921504606846976 END)"
_RULE = {
    "when-shifted": f"(shift = 0 OR (a_title = b_title AND {_GUARD}))",
    "always": f"(a_title = b_title AND (shift = 0 OR {_GUARD}))",
    "never": f"(shift = 0 OR {_GUARD})",
}


def _sides(spark, sf_dir, **more):
    rows = sched(spark, sf_dir, **more).withColumn("id", F.col("seq"))
    return rows.where("site = 0"), rows.where("site = 1")


for _name, _titles, _tol in (("band_match_pairs", "never", 900), ("match_title_rule", "when-shifted", 900), ("match_title_rule_always", "always", 900), ("match_title_rule_never", "never", 300), ("match_duration_guard", "when-shifted", 7200)):

    @query(_name, f"WITH {_sched_sql()}, {_PAIR.format(tol=_tol)} SELECT channel, a_id, b_id FROM j WHERE {_RULE[_titles]}")
    def _(spark, sf_dir, titles=_titles, tol=_tol):
        return match.band_pairs(*_sides(spark, sf_dir), tol, titles).select("channel", "a_id", "b_id")


@query("nearest_match", f"WITH {_sched_sql()}, {_PAIR.format(tol=3600)}, r AS (SELECT *, row_number() OVER (PARTITION BY channel, b_id ORDER BY shift, a_st, a_id) AS n FROM j WHERE {_RULE['never']}) SELECT channel, b_id, a_id, shift FROM r WHERE n = 1")
def _(spark, sf_dir):
    best = match.nearest_pairs(*_sides(spark, sf_dir), 3600)
    return best.select("channel", "b_id", "a_id", F.abs(F.col("a_st") - F.col("b_st")).alias("shift"))


def _greedy(name: str, title: str):
    sql = f"""WITH RECURSIVE {_sched_sql("'one'")}, p AS MATERIALIZED (SELECT site, st, min(seq) AS id, arg_min(sp, seq) FILTER (sp IS NOT NULL) AS sp, list_distinct(list({title})) AS ts FROM sched WHERE site < 2 GROUP BY site, st),
      inc AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY st) AS rn FROM p WHERE site = 1),
      cand AS MATERIALIZED (SELECT i.id, list(a.id ORDER BY abs(a.st - i.st), a.st) AS cs FROM inc i JOIN p a ON a.site = 0 AND abs(a.st - i.st) <= 300 AND (a.st = i.st OR (list_has_any(a.ts, i.ts)
        AND abs(a.st - i.st) < least(CASE WHEN a.sp > a.st THEN a.sp - a.st ELSE 1152921504606846976 END, CASE WHEN i.sp > i.st THEN i.sp - i.st ELSE 1152921504606846976 END))) GROUP BY i.id),
      step AS MATERIALIZED (SELECT i.rn, i.id, c.cs FROM inc i LEFT JOIN cand c USING (id)),
      walk AS (SELECT 0::BIGINT AS rn, NULL::BIGINT AS id, NULL::BIGINT AS pick, []::BIGINT[] AS taken
        UNION ALL SELECT rn, id, pick, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END FROM
        (SELECT s.rn, s.id, w.taken, list_filter(coalesce(s.cs, []), lambda x: NOT list_contains(w.taken, x))[1] AS pick FROM walk w JOIN step s ON s.rn = w.rn + 1))
      SELECT id AS b_id, pick AS a_id FROM walk WHERE pick IS NOT NULL"""

    @query(name, sql)
    def run(spark, sf_dir):
        rows = sched(spark, sf_dir, "'one'").where("site < 2")
        rows = rows.select("channel", F.lit(0).alias("day_idx"), F.lit(FIRST).cast("long").alias("midnight"), F.col("site").alias("source"), "seq", F.col("seq").alias("id"), "st", "sp", F.array(F.lit("x") if title == "'x'" else F.col("title")).alias("titles"))
        met = fold.groups(rows).where("source = 0").select("group_id", F.explode("members").alias("m"))
        return met.where("m.source = 1").select(F.col("m.id").alias("b_id"), F.col("group_id").alias("a_id"))


_greedy("greedy_fold_pair", "title")
_greedy("greedy_fold_contended", "'x'")


def guide_rows(spark, sf_dir):
    """Three sources over all days; each fiftieth row is reported by the day after its own."""
    rows = sched(spark, sf_dir)
    day = F.expr("day_idx + if(seq % 50 = 0, 1, 0)")
    return rows.select("channel", day.alias("day_idx"), (F.lit(FIRST) + day * 86400).cast("long").alias("midnight"), F.col("site").alias("source"), "seq", F.col("seq").alias("id"), "st", "sp", F.array(text.normal_title(F.col("title"))).alias("titles"))


@query("greedy_fold_guide")
def _(spark, sf_dir):
    done = fold.ordered(fold.groups(guide_rows(spark, sf_dir)))
    return polish.polish(done).select("channel", "group_id", "out_seq", "st", F.col("sp").alias("stop"), "n_rows")


# ---------------------------------------------------------------- ingest

_NOW = FIRST + 30 * 86400


def _stale(spark, sf_dir):
    entries = sched(spark, sf_dir).withColumn("day", F.expr("date_add(date'2024-01-01', day_idx)"))
    meta = entries.groupBy(F.lit("s").alias("site"), F.col("channel").alias("channel_id"), "day").agg(F.max("st").alias("grabbed_at"), F.count_if(F.col("sp").isNotNull()).cast("int").alias("programme_count"))
    channels = entries.select(F.lit("s").alias("site"), F.col("channel").alias("channel_id")).distinct().withColumn("channel_rank", F.substring("channel_id", 3, 9).cast("int"))
    days = ingest.day_window(spark, "2024-01-03", 30)
    return ingest.stale_grid(channels, days, meta, F.to_date(F.lit("2024-01-20")), F.lit(_NOW), ingest.Policy(2, 14, 1))


_GRID = f"""{_sched_sql()}, m AS (SELECT channel, day_idx, max(st) AS g, count(*) FILTER (sp IS NOT NULL) AS c FROM sched GROUP BY ALL),
  grid AS (SELECT channel, CAST(substr(channel, 3) AS INT) AS channel_rank, CAST(d AS INT) AS d FROM (SELECT DISTINCT channel FROM sched), range(30) r(d)),
  s AS (SELECT grid.channel, channel_rank, d, g IS NULL OR (d + 2 - 19 >= 0 AND d + 2 - 19 < 2) OR {_NOW} - g > CASE WHEN c = 0 THEN 1 ELSE 14 END * 86400 AS stale FROM grid LEFT JOIN m ON m.channel = grid.channel AND m.day_idx = d + 2)"""


@query("stale_grid", f"WITH {_GRID} SELECT channel, d AS day_idx, stale FROM s")
def _(spark, sf_dir):
    return _stale(spark, sf_dir).select(F.col("channel_id").alias("channel"), "day_idx", "stale")


for _mode, _ch, _dy in (("none", 0, 0), ("channels", 4, 0), ("days", 0, 7), ("both", 3, 10)):
    _c, _d = ingest.batching(_mode, _ch, _dy)
    _dg = f"d // {_d}" if _d else "0"
    _cg = f"(dense_rank() OVER (PARTITION BY dg ORDER BY channel_rank) - 1) // {_c}" if _c else "0"

    @query(f"request_plan_{_mode}", f"""WITH {_GRID}, g AS (SELECT *, {_dg} AS dg FROM s WHERE stale), h AS (SELECT *, {_cg} AS cg FROM g)
      SELECT CAST(dg AS BIGINT) AS day_grp, CAST(cg AS BIGINT) AS ch_grp, count(*) AS n_pairs, CAST(count(DISTINCT channel) AS BIGINT) AS n_channels, string_agg(DISTINCT d, ',' ORDER BY d) AS days FROM h GROUP BY dg, cg""")  # fmt: skip
    def _(spark, sf_dir, c=_c, d=_d):
        plan = ingest.request_list(ingest.requests(_stale(spark, sf_dir).where("stale"), c, d))
        return plan.selectExpr("cast(day_grp as bigint) as day_grp", "cast(ch_grp as bigint) as ch_grp", "n_pairs", "cast(size(channels) as bigint) as n_channels", "array_join(transform(days, x -> cast(x as string)), ',') as days")


@query("prune_days", f"WITH {_sched_sql()} SELECT channel, count(DISTINCT (site, day_idx)) AS removed FROM sched WHERE day_idx < 12 GROUP BY channel")
def _(spark, sf_dir):
    entries = sched(spark, sf_dir).selectExpr("cast(site as string) as site", "channel as channel_id", "date_add(date'2024-01-01', day_idx) as day")
    return ingest.pruned(entries, F.lit("2024-01-13").cast("date")).groupBy(F.col("channel_id").alias("channel")).agg(F.count("*").alias("removed"))


@query("grab_summary", "SELECT count(*) FILTER (event_id % 4 < 2) AS fetched, count(*) FILTER (event_id % 4 < 2 AND event_id % 8 = 0) AS empty, count(*) FILTER (event_id % 4 = 2) AS from_cache, count(*) FILTER (event_id % 4 = 3) AS failed FROM events")
def _(spark, sf_dir):
    return ingest.summary(table(spark, sf_dir, "events").selectExpr("case event_id % 4 when 2 then 'cached' when 3 then 'failed' else 'fetched' end as status", "event_id % 8 as programme_count"))


@query("day_window", "SELECT strftime(DATE '2024-02-26' + CAST(d AS INT), '%Y-%m-%d') AS day, CAST(d AS INT) AS day_idx, CAST(d - 3 AS INT) AS ahead FROM range(9) r(d)")
def _(spark, sf_dir):
    return ingest.day_window(spark, "2024-02-26", 9).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "day_idx", F.datediff("day", F.lit("2024-02-29")).alias("ahead"))


# ---------------------------------------------------------------- scalar functions


def _dated(spark, sf_dir):
    off = "cast((event_id % 27 - 13) * 60 + if(event_id % 5 = 0, 30, 0) as int)"
    return table(spark, sf_dir, "events").selectExpr("event_id", "date_trunc('second', ts) as t", f"{off} as off", "cast(4 + event_id % 6 * 2 as int) as prec")


_DATED = """e AS (SELECT event_id, date_trunc('second', ts) AS t, CAST((event_id % 27 - 13) * 60 + CASE WHEN event_id % 5 = 0 THEN 30 ELSE 0 END AS INT) AS off, CAST(4 + event_id % 6 * 2 AS INT) AS prec FROM events),
  f AS (SELECT *, left(strftime(t + to_minutes(off), '%Y%m%d%H%M%S'), prec) || ' ' || CASE WHEN off < 0 THEN '-' ELSE '+' END || lpad(CAST(abs(off) // 60 AS VARCHAR), 2, '0') || lpad(CAST(abs(off) % 60 AS VARCHAR), 2, '0') AS s FROM e)"""


@query("date_format", f"WITH {_DATED} SELECT event_id, s FROM f")
def _(spark, sf_dir):
    return _dated(spark, sf_dir).select("event_id", dates.format_date(F.col("t").cast("timestamp_ntz"), F.col("off"), F.col("prec")).alias("s"))


@query("date_parse", f"""WITH {_DATED}, g AS (SELECT event_id, off, prec, t, s FROM f)
  SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE epoch_ms(strptime(rpad(left(strftime(t + to_minutes(off), '%Y%m%d%H%M%S'), prec), 14, right('00000101000000', 14 - prec)), '%Y%m%d%H%M%S') - to_minutes(off)) // 1000 END AS st,
  CASE WHEN event_id % 9 <> 0 THEN off END AS off, CASE WHEN event_id % 9 <> 0 THEN prec END AS prec FROM g""")  # fmt: skip
def _(spark, sf_dir):
    bad = "case event_id % 27 when 0 then '20240230' when 9 then s || '0' else replace(s, ' ', ' x') end"
    rows = _dated(spark, sf_dir).select("event_id", dates.format_date(F.col("t").cast("timestamp_ntz"), F.col("off"), F.col("prec")).alias("s")).withColumn("s", F.expr(f"if(event_id % 9 = 0, {bad}, s)"))
    d = rows.select("event_id", dates.parse_date(F.col("s")).alias("d"))
    return d.select("event_id", F.expr("cast(timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', d.ts) as bigint) as st"), F.col("d.off").alias("off"), F.col("d.prec").alias("prec"))


_ESCAPED = "replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


@query("escape_text", f"SELECT doc_id, md5({_ESCAPED.format(x='text')}) AS h, CAST(length({_ESCAPED.format(x='text')}) AS BIGINT) AS n FROM documents")
def _(spark, sf_dir):
    escaped = text.escape_xml(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(escaped.cast("binary")).alias("h"), F.length(escaped).cast("long").alias("n"))


_DECODED = "html"
for _char, _entity in text.ESCAPES[::-1]:  # the ampersand last: nothing is decoded twice
    _DECODED = f"replace({_DECODED}, '{_entity}', '{_char.replace(chr(39), chr(39) * 2)}')"


@query("decode_entities", f"SELECT page_id, md5({_DECODED}) AS h FROM pages")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.decode_entities(F.col("html")).cast("binary")).alias("h"))


@query("title_key", "SELECT doc_id, md5(trim(regexp_replace(lower(strip_accents(text)), '\\s+', ' ', 'g'))) AS k FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normal_title(F.col("text")).cast("binary")).alias("k"))


@query("titles_overlap", f"WITH {_HOUR}, a AS (SELECT channel, st, list(title) AS x FROM sched WHERE site = 0 GROUP BY ALL), b AS (SELECT channel, st, list(title) AS y FROM sched WHERE site = 1 GROUP BY ALL) SELECT channel, st, list_has_any(x, y) AS same FROM a JOIN b USING (channel, st)")
def _(spark, sf_dir):
    rows = _hourly(spark, sf_dir)
    a, b = (rows.where(f"site = {k}").groupBy("channel", "st").agg(F.collect_list(text.normal_title(F.col("title"))).alias(n)) for k, n in ((0, "x"), (1, "y")))
    return a.join(b, ["channel", "st"]).select("channel", "st", text.titles_match(F.col("x"), F.col("y")).alias("same"))


@query("episode_numbers", """SELECT l_orderkey, l_linenumber, (l_orderkey % 120) || '.' || (l_linenumber - 1) || '.0/1' AS ns,
  'S' || CASE WHEN l_orderkey % 120 + 1 < 10 THEN '0' ELSE '' END || (l_orderkey % 120 + 1) || 'E0' || l_linenumber AS screen FROM lineitem""")  # fmt: skip
def _(spark, sf_dir):
    season, episode = F.col("l_orderkey") % 120 + 1, F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.xmltv_ns(season, episode).alias("ns"), text.onscreen(season, episode).alias("screen"))


# ---------------------------------------------------------------- selection, lineups, joins


@query("new_channels", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders")
def _(spark, sf_dir):
    return registry.only_in(table(spark, sf_dir, "customer").selectExpr("c_custkey as id"), table(spark, sf_dir, "orders").selectExpr("o_custkey as id"), "id")


@query("gone_channels", "SELECT o_custkey AS id FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_nationkey < 20")
def _(spark, sf_dir):
    return registry.only_in(table(spark, sf_dir, "orders").selectExpr("o_custkey as id"), table(spark, sf_dir, "customer").where("c_nationkey < 20").selectExpr("c_custkey as id"), "id")


@query("selection_filter", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def _(spark, sf_dir):
    chosen = table(spark, sf_dir, "orders").where("o_totalprice > 200000").selectExpr("o_custkey as c_custkey")
    return registry.selected(table(spark, sf_dir, "customer"), chosen, "c_custkey").select("c_custkey", "c_name")


@query("number_selection", """WITH t AS (SELECT c_custkey, (c_custkey % 30 + 1) || '-' || (c_nationkey % 30 + 1) || ',' || (c_custkey % 7 + 1) AS s, c_custkey % 30 + 1 AS a, c_nationkey % 30 + 1 AS b, c_custkey % 7 + 1 AS c FROM customer),
  p AS (SELECT c_custkey, unnest(list_distinct(list_append(range(least(a, b) - 1, greatest(a, b)), c - 1))) AS n FROM t WHERE greatest(a, b) <= 28)
  SELECT t.c_custkey, (SELECT string_agg(n, ',' ORDER BY n) FROM p WHERE p.c_custkey = t.c_custkey) AS picks FROM t""")  # fmt: skip
def _(spark, sf_dir):
    asked = F.concat((F.col("c_custkey") % 30 + 1).cast("string"), F.lit("-"), (F.col("c_nationkey") % 30 + 1).cast("string"), F.lit(","), (F.col("c_custkey") % 7 + 1).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(config.selection(asked, F.lit(28)), ",").alias("picks"))


@query("distinct_first_seen", "SELECT o_custkey AS id, min(o_orderkey) AS first_seen FROM orders GROUP BY o_custkey")
def _(spark, sf_dir):
    return registry.distinct_ids(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").selectExpr("o_custkey as id", "first_seen")


@query("lineup_entries", """SELECT r_name AS lineup, CAST(s_suppkey AS VARCHAR) AS id, s_name AS station, CASE WHEN s_suppkey % 2 = 0 THEN n_name ELSE 'en' END AS lang, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS preset
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")  # fmt: skip
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    channels = rows.selectExpr("r_name as site", "s_suppkey as channel_rank", "cast(s_suppkey as string) as xmltv_id", "s_name as name", "if(s_suppkey % 2 = 0, n_name, null) as lang", "cast(null as string) as logo", "lpad(cast(s_suppkey as string), 6, '0') as preset")
    return lineups.entries(channels, "en").select("lineup", F.col("station.xmltv_id").alias("id"), F.col("station.name").alias("station"), "station.lang", "preset")


def _guide(spark, sf_dir, **options):
    """``events`` as the cache of three sites, built into a guide without matching."""
    at = lambda c: f"if({c} is null, null, named_struct('ts', timestamp_seconds({c}), 'off', 0, 'prec', 14))"
    given = {"start": at("st"), "stop": at("sp"), "showview": "cast(seq as string)", "title": "array(named_struct('value', title, 'lang', cast(null as string), 'attrs', cast(null as map<string,string>)))"}
    fields = [f"{given[f]} as {f}" if f in given else "channel" if f == "channel" else f"cast(null as {t}) as {f}" for f, t in schema.PROGRAMME.items()]
    programmes = sched(spark, sf_dir).selectExpr("seq", *fields, "concat('s', site) as site", "channel as channel_id", "date_add(date'2024-01-01', day_idx) as day")
    rows = [(f"s{k}", k, c, f"ch{c}", f"ch{c}", f"Channel {c}", None, None, None) for k in range(3) for c in range(10)]
    channels = spark.createDataFrame(rows, "site string, site_rank int, channel_rank int, xmltv_id string, site_id string, name string, lang string, logo string, preset string")
    return guide.build(spark, channels, programmes, "2024-01-01", 31, guide.MergeOptions(programme_strategy="concat", fill_stop_ms=None, clip_overlaps=False, **options))["programmes"]


@query("site_transform", f"WITH {_sched_sql()} SELECT channel, seq, CASE WHEN site = 1 THEN upper(title) ELSE title END AS title FROM sched WHERE NOT (site = 2 AND seq % 7 = 0)")
def _(spark, sf_dir):
    loud = lambda rows: rows.withColumn("title", F.transform("title", lambda t: t.withField("value", F.upper(t["value"]))))
    rows = _guide(spark, sf_dir, site_transforms={"s1": loud, "s2": lambda rows: rows.where("seq % 7 <> 0")})
    return rows.select("channel", F.col("showview").cast("long").alias("seq"), F.col("title")[0]["value"].alias("title"))


@query("guide_transform", f"WITH {_sched_sql()}, {_NEXT.replace('ORDER BY st, seq', 'ORDER BY st, day_idx, site, seq')} SELECT channel, seq, CASE WHEN next_st - st < 600 THEN 'short' ELSE 'long' END AS kind FROM n WHERE next_st IS NOT NULL AND seq % 11 <> 0")
def _(spark, sf_dir):
    gap = F.unix_seconds("next_start.ts") - F.unix_seconds("start.ts")
    change = lambda rows: rows.where(F.col("next_start").isNotNull() & (F.col("showview").cast("long") % 11 != 0)).withColumn("kind", F.when(gap < 600, "short").otherwise("long"))
    return _guide(spark, sf_dir, transform=change).select("channel", F.col("showview").cast("long").alias("seq"), "kind")


@query("star_priority_join", """SELECT l_orderkey, l_linenumber, o_orderpriority, n_name AS site, n_nationkey AS site_rank FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND o_orderpriority LIKE '1%'""")  # fmt: skip
def _(spark, sf_dir):
    sites = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    channels = sites.selectExpr("n_name as site", "cast(n_nationkey as int) as site_rank", "cast(s_suppkey as int) as channel_rank", "s_suppkey as xmltv_id")
    facts = table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp_ntz'1997-01-01 00:00:00'").selectExpr("l_orderkey", "l_linenumber", "l_suppkey as xmltv_id")
    heads = table(spark, sf_dir, "orders").where("o_orderpriority like '1%'").select("o_orderkey", "o_orderpriority")
    rows = registry.covering(facts.join(heads, F.col("l_orderkey") == F.col("o_orderkey")), registry.registry(channels), on_site=False)
    return rows.select("l_orderkey", "l_linenumber", "o_orderpriority", "site", F.col("site_rank").cast("long").alias("site_rank"))


# ---------------------------------------------------------------- documents


def _programme_rows(schedule):
    at = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.timestamp_seconds(c).alias("ts"), F.lit(0).alias("off"), F.lit(14).alias("prec")))
    title = F.array(F.struct(F.concat(F.col("title"), F.lit(" & <co>")).alias("value"), F.lit("en").alias("lang")))
    return schedule.select("seq", "st", "sp", F.struct(at("st").alias("start"), at("sp").alias("stop"), F.col("channel").alias("channel"), title.alias("title")).alias("p"))


@query("programme_xml", f"""WITH {_sched_sql()} SELECT seq, '<programme start="' || strftime(make_timestamp(st * 1000000), '%Y%m%d%H%M%S') || ' +0000"' ||
  CASE WHEN sp IS NULL THEN '' ELSE ' stop="' || strftime(make_timestamp(sp * 1000000), '%Y%m%d%H%M%S') || ' +0000"' END || ' channel="' || channel || '"><title lang="en">' || title || ' &amp; &lt;co&gt;</title></programme>' AS xml FROM sched""")  # fmt: skip
def _(spark, sf_dir):
    return xml_sink.with_xml(_programme_rows(sched(spark, sf_dir)), "programme", F.col("p"), "seq")


@query("xml_roundtrip", f"WITH {_sched_sql()} SELECT seq, st, sp, channel, title || ' & <co>' AS title FROM sched")
def _(spark, sf_dir):
    schedule = spread(sched(spark, sf_dir).select("seq", "st", "sp", "channel", "title"), "seq")
    xml = xml_sink.with_xml(_programme_rows(schedule), "programme", F.col("p"), "seq")
    xml = xml.select(F.col("seq").cast("string").alias("path"), F.concat(F.lit("<tv>"), "xml", F.lit("</tv>")).alias("content"))
    back = xml_source.tables(xml_source.parse_column(xml, wanted={"programme": ["start", "stop", "channel", "title"]}))["programmes"]
    return back.select(F.col("path").cast("long").alias("seq"), F.unix_seconds("start.ts").alias("st"), F.unix_seconds("stop.ts").alias("sp"), "channel", F.col("title")[0]["value"].alias("title"))


@query("warnings_by_code", """SELECT code, count(*) AS n FROM (SELECT unnest(CASE event_id % 5 WHEN 0 THEN ['invalid-attribute', 'invalid-programme'] WHEN 1 THEN ['unknown-element'] WHEN 2 THEN ['truncated-input']
  WHEN 3 THEN ['malformed-markup', 'invalid-element'] ELSE [] END) AS code FROM events) GROUP BY code""")  # fmt: skip
def _(spark, sf_dir):
    bad = """case event_id % 5 when 0 then '<programme start="20240230" channel="a"/></tv>' when 1 then '<other/></tv>' when 2 then '<programme start="2024" channel="a">'
      when 3 then '</x><channel/></tv>' else '<channel id="a"/></tv>' end"""
    docs = spread(table(spark, sf_dir, "events").select("event_id"), "event_id").selectExpr("cast(event_id as string) as path", f"concat('<tv>', {bad}) as content")
    return xml_source.tables(xml_source.parse_column(docs, wanted={"warning": ()}))["warnings"].groupBy("code").agg(F.count("*").alias("n"))
