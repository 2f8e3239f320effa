"""Queries of run status documents, orphaned runs, table constraints, image slices, report lines and rendered bodies, each with its DuckDB SQL. Runs are a user's days of events, images are order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallygrove.functions import bodies
from tallygrove.operators import images, status, updates
from tallygrove.sources import sinks
from tallygrove.sources.landing import dealt, tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


_LOG = """
e AS (
    SELECT user_id AS job, ts::DATE AS run, ts, event_id AS seq, CASE event_type WHEN 'click' THEN 'step' WHEN 'view' THEN 'progress' WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'failed' ELSE 'finish' END AS kind,
        's' || event_id % 7 AS step, floor(value)::BIGINT AS done, floor(value)::BIGINT + 5 AS total, repeat(props, 30) AS error FROM events
), numbered AS (
    SELECT *, count(*) FILTER (kind = 'step') OVER (PARTITION BY job, run ORDER BY ts, seq) AS step_no FROM e
), filled AS (
    SELECT * EXCLUDE (done, total), last_value(CASE WHEN kind = 'progress' THEN done END IGNORE NULLS) OVER w AS done, last_value(CASE WHEN kind = 'progress' THEN total END IGNORE NULLS) OVER w AS total
    FROM numbered WINDOW w AS (PARTITION BY job, run, step_no ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), runs AS (
    SELECT job, run, min(ts) AS started_at, max(ts) FILTER (kind = 'finish') AS finished_at, arg_max(step, (ts, seq)) FILTER (kind = 'step') AS last_step,
        max(ts) FILTER (kind = 'step') AS step_started_at, arg_max([done], (ts, seq))[1] AS step_done, arg_max([total], (ts, seq))[1] AS step_total, max(ts) FILTER (kind IN ('step', 'progress')) AS progress_at,
        coalesce(string_agg(step, ',' ORDER BY ts, seq) FILTER (kind = 'ok'), '') AS completed,
        coalesce(string_agg(concat_ws(':', step, substr(error, 1, 300), coalesce(done::VARCHAR, '-'), coalesce(total::VARCHAR, '-')), ',' ORDER BY ts, seq) FILTER (kind = 'failed'), '') AS failed
    FROM filled GROUP BY job, run
), told AS (
    SELECT *, CASE WHEN finished_at IS NULL THEN 'running' WHEN failed <> '' THEN 'failed' ELSE 'done' END AS state FROM runs
), documents_of_runs AS (
    SELECT job, run, state, started_at, finished_at, CASE WHEN finished_at IS NULL THEN last_step END AS step, step_started_at, step_done, step_total, progress_at, completed, failed,
        last_value(CASE WHEN state = 'done' THEN finished_at END IGNORE NULLS) OVER (PARTITION BY job ORDER BY started_at, run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_done_at FROM told
)"""


def _status(spark, d):
    (events,) = tables(spark, d, "events")
    kind = F.create_map(*[F.lit(x) for x in ("click", "step", "view", "progress", "purchase", "ok", "error", "failed", "signup", "finish")])
    done = F.floor("value")
    log = events.select(
        F.col("user_id").alias("job"), F.to_date("ts").alias("run"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), kind[F.col("event_type")].alias("kind"),
        F.concat(F.lit("s"), F.col("event_id") % 7).alias("step"), done.alias("done"), (done + 5).alias("total"), F.repeat("props", F.lit(30)).alias("error"),
    )
    return status.run_status(log)


def _flat(documents):
    failed = F.transform("failures", lambda x: F.concat_ws(":", x["step"], x["error"], F.coalesce(x["done"].cast("string"), F.lit("-")), F.coalesce(x["total"].cast("string"), F.lit("-"))))
    return documents.withColumns({"completed": F.array_join("completed_steps", ","), "failed": F.array_join(failed, ",")}).drop("completed_steps", "failures")


@query(f"WITH {_LOG} SELECT * FROM documents_of_runs")
def run_status(spark, d):
    return _flat(_status(spark, d))


@query(f"WITH {_LOG} SELECT * FROM documents_of_runs QUALIFY row_number() OVER (PARTITION BY job ORDER BY started_at DESC, run DESC) = 1")
def current_status(spark, d):
    return _flat(status.current(_status(spark, d)))


@query("""SELECT event_id, ts, CASE WHEN dead THEN TIMESTAMP '2024-01-30 00:00:00' WHEN event_type <> 'error' THEN ts END AS ended, CASE WHEN dead THEN 'failed' ELSE event_type END AS result,
CASE WHEN dead THEN coalesce(note, '') || ' [orphan: process killed before finish]' ELSE note END AS error
FROM (SELECT *, CASE WHEN value > 50 THEN props END AS note, event_type = 'error' AND ts < TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 30 MINUTE AS dead FROM events)""")
def orphans_closed(spark, d):
    (events,) = tables(spark, d, "events")
    runs = events.select("event_id", "ts", F.when(F.col("event_type") != "error", F.col("ts")).alias("ended"), F.col("event_type").alias("result"), F.when(F.col("value") > 50, F.col("props")).alias("error"))
    return updates.orphans_closed(runs, started="ts", ended="ended", result="result", error="error", as_of="2024-01-30 00:00:00", minutes=30)


@query("""SELECT o_orderkey, array_to_string(list_sort(list_filter([CASE WHEN o_totalprice >= 400000 THEN 'price' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status' END,
CASE WHEN count(*) OVER (PARTITION BY o_custkey, o_orderdate) > 1 THEN 'once a day' END], lambda x: x IS NOT NULL)), ',') AS violated FROM orders
QUALIFY violated <> ''""")
def broken_constraints(spark, d):
    (orders,) = tables(spark, d, "orders")
    checks = {"price": F.col("o_totalprice") < 400_000, "status": F.col("o_orderstatus").isin("F", "O")}
    return updates.violations(orders, checks, {"once a day": ["o_custkey", "o_orderdate"]}).select("o_orderkey", F.array_join("violated", ",").alias("violated"))


@query("""WITH sized AS (SELECT l_orderkey, l_linenumber, least(w, 1000) AS width, CASE WHEN w > 1000 THEN h * 1000 // w ELSE h END AS height
    FROM (SELECT *, (l_partkey % 2500)::INT AS w, floor(l_extendedprice / 8)::INT AS h FROM lineitem) WHERE w >= 200 AND h >= 200
), cut AS (SELECT l_orderkey, l_linenumber, width, height, unnest(range(0, height, 1100)) AS y FROM sized), numbered AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, y) - 1 AS part FROM cut)
SELECT l_orderkey, l_linenumber, part, width, greatest(0, y - 40) AS top, least(height, y + 1100) AS bottom FROM numbered WHERE part < 14""")
def image_slices(spark, d):
    (lines,) = tables(spark, d, "lineitem")
    w, h = F.col("l_partkey") % 2500, F.floor(F.col("l_extendedprice") / 8)
    number = lambda c: F.lpad(F.hex(c.cast("long")), 8, "0")
    short = lambda c: F.concat(F.substring(number(c), 7, 2), F.substring(number(c), 5, 2))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), number(w), number(h), F.lit("0802000000"))
    gif = F.concat(F.lit("474946383961"), short(w), short(h), F.lit("F70000"))
    uri = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("data:image/gif;base64,"), F.base64(F.unhex(gif)))).otherwise(F.concat(F.lit("data:image/png;base64,"), F.base64(F.unhex(png))))
    size = images.image_size(images.data_content(F.col("uri")))
    return images.slices(lines.withColumn("uri", uri).select("l_orderkey", "l_linenumber", size.alias("size")).select("l_orderkey", "l_linenumber", "size.*"), posting="l_orderkey", ordinal="l_linenumber")


@query("SELECT s_suppkey, rpad(s_suppkey::VARCHAR, greatest(15, length(s_suppkey::VARCHAR))::INT, ' ') || ' | ' || rpad(coalesce(x, '(none)'), greatest(20, length(coalesce(x, '(none)')))::INT, ' ') || ' | ' || s_nationkey AS line FROM (SELECT *, CASE WHEN s_nationkey > 3 THEN repeat(s_name, 1 + s_nationkey % 2) END AS x FROM supplier)")
def name_lines(spark, d):
    (supplier,) = tables(spark, d, "supplier")
    name = F.when(F.col("s_nationkey") > 3, F.repeat("s_name", (1 + F.col("s_nationkey") % 2).cast("int")))
    return supplier.select("s_suppkey", sinks.aligned((F.col("s_suppkey").cast("string"), 15), (F.coalesce(name, F.lit("(none)")), 20), (F.col("s_nationkey").cast("string"), 0)).alias("line"))


def _row(heading: str, value: str) -> str:
    """SQL for a row of a rendered table; nothing where value is null."""
    return f"coalesce('<tr><th>{heading}</th><td>' || {value} || '</td></tr>', '')"


@query(f"""
WITH a AS (SELECT *, p_size % 5 AS k, p_name || ' & "' || p_type || '"' AS spoken, replace(replace(p_name || ' & "' || p_type || '"', '&', '&amp;'), '"', '&quot;') AS safe, (p_retailprice * 100)::BIGINT AS cents FROM part)
SELECT p_partkey,
    concat_ws(chr(10), CASE WHEN k <> 0 THEN '<p><b>Publish Date:</b> 2024-03-0' || k || '  <b>Closing Date:</b> </p>' END,
        '<table>' || {_row("Level", "p_type")} || {_row("Term", "CASE WHEN k > 2 THEN p_brand END")} || {_row("Year of Exp", "CASE WHEN k > 0 THEN k END")}
            || {_row("Language", "p_type || ' — ' || p_brand || ', ' || p_name")} || {_row("Age", "CASE WHEN k > 0 THEN k || '–' || p_size ELSE '0–' || p_size END")} || '</table>',
        CASE WHEN k <> 1 THEN '<h3>Job Description</h3>' || chr(10) || '<pre style=''white-space:pre-wrap;font-family:inherit''>' || safe || '</pre>' END,
        CASE WHEN k = 3 THEN '<h3>Contact</h3>' || chr(10) || '<table>' || {_row("Company", "p_brand")} || {_row("Email", "p_brand || '@' || p_partkey")} || '</table>' END) AS labelled,
    concat_ws(chr(10),
        '<table>' || {_row("급여", "'USD ' || format('{:,}', cents) || CASE WHEN k > 1 THEN ' ~ ' || format('{:,}', cents + k) ELSE '' END || CASE k WHEN 1 THEN '/시' WHEN 2 THEN '/일' WHEN 3 THEN '/주' WHEN 4 THEN '/월' ELSE '' END")}
            || {_row("인턴십", "CASE WHEN p_size > 25 THEN '가능' END")} || '</table>',
        '<h3>주요 업무</h3>' || chr(10) || '<p>' || p_name || '</p>' || chr(10),
        CASE WHEN k <> 4 THEN '<h3>회사 정보</h3>' || chr(10) || '<table>' || {_row("회사명", "p_brand")} || {_row("주소", "p_type || ' ' || p_name")} || '</table>' END) AS marked_up
FROM a""")
def rendered_bodies(spark, d):
    (part,) = tables(spark, d, "part")
    k, text = F.col("p_size") % 5, lambda *xs: F.concat(*[x if not isinstance(x, str) else F.col(x) for x in xs])
    named = lambda x, key="label": F.struct(F.col(x).alias(key))
    either = lambda **of: F.struct(*[of.get(x, F.lit(None).cast("string")).alias(x) for x in ("label", "name")])
    langs = F.array(*[F.struct(one.alias("languageId"), level.alias("languageLevelId")) for one, level in ((either(label=F.col("p_type")), either(name=F.col("p_brand"))), (either(name=F.col("p_name")), either()))])
    labelled = F.struct(
        F.when(k != 0, text(F.lit("2024-03-0"), k, F.lit("T09:00"))).alias("pubdate"), named("p_type").alias("jobLevelId"), F.when(k > 2, named("p_brand", "name")).alias("termId"), k.alias("workyears"), langs.alias("jobLangs"),
        k.alias("ageFrom"), F.col("p_size").alias("ageTo"), F.when(k != 1, text("p_name", F.lit(' & "'), "p_type", F.lit('"'))).alias("description"), (k == 3).alias("showEmail"),
        F.when(k == 3, F.struct(F.col("p_brand").alias("company"), text("p_brand", F.lit("@"), "p_partkey").alias("email"))).alias("employer"),
    )
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    job = F.struct(
        cents.alias("min_salary"), F.when(k > 1, cents + k).alias("max_salary"), k.alias("salary_unit"), F.lit("USD").alias("salary_currency"),
        (F.col("p_size") > 25).alias("internship"), text(F.lit("<p>"), "p_name", F.lit("</p>")).alias("task"),
    )
    company = F.when(k != 4, F.struct(F.col("p_brand").alias("name"), F.col("p_type").alias("address"), F.col("p_name").alias("city")))
    answers = dealt(part).select("p_partkey", F.to_json(labelled).alias("labels"), F.to_json(F.struct(job.alias("job"), company.alias("company"))).alias("marks"))
    one = bodies.rendered(answers, "labels", {"labelled": bodies.labelled_body})
    return bodies.rendered(one, "marks", {"marked_up": bodies.marked_up_body}).select("p_partkey", "labelled", "marked_up")
