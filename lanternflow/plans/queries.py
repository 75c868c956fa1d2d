"""The driver's queries over the detection operators, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternflow.config import DEFAULT
from lanternflow.functions import geometry as G
from lanternflow.operators import analysis, annotate, debounce, detect, gate, labels
from lanternflow.plans.flagship import Detections
from lanternflow.sources import sinks
from lanternflow.sources import testdata as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Stages of the chain in SQL; a query names those it needs.  Everything is derived from `events`.
_CTE = {
    "ev": "SELECT event_id, user_id, event_type, value, event_id // 12 AS frame_idx FROM events",
    "det": """SELECT frame_idx, frame_idx / 15e0 AS ts_s, event_id AS det_ord,
        CASE WHEN event_type = 'purchase' THEN user_id % 3 ELSE 1000 + user_id END AS track_id,
        CASE WHEN event_type = 'purchase' THEN 2 ELSE 0 END AS class_id, least(value / 100e0, 0.99e0) AS confidence,
        (event_id * 97 + user_id * 31) % 816 - (20 + event_id % 60) / 2e0 AS x1, (event_id * 57 + user_id * 13) % 448 - (40 + event_id % 90) / 2e0 AS y1,
        (event_id * 97 + user_id * 31) % 816 + (20 + event_id % 60) / 2e0 AS x2, (event_id * 57 + user_id * 13) % 448 + (40 + event_id % 90) / 2e0 AS y2
        FROM ev WHERE event_type IN ('purchase', 'view', 'click', 'signup')""",
    "obj": """SELECT * FROM det QUALIFY row_number() OVER (PARTITION BY frame_idx, track_id ORDER BY det_ord) = 1""",
    "per": "SELECT * FROM obj WHERE class_id = 0",
    "veh": "SELECT * FROM obj WHERE class_id <> 0",
    "raw": """SELECT per.frame_idx, per.track_id AS person_track_id, e.event_id AS box_ord,
        CASE (e.event_id // 5) % 5 WHEN 0 THEN 'Person' WHEN 1 THEN 'weapon' WHEN 2 THEN 'Phone' WHEN 3 THEN 'pistol' END AS class_name,
        least(e.value / 60e0, 0.99e0) AS confidence, e.event_id % 50 AS bx, e.event_id % 40 AS bt
        FROM per JOIN ev e ON e.frame_idx = per.frame_idx AND e.event_type = 'error'""",
    "pair": """SELECT p.frame_idx, p.track_id AS person_track_id, p.det_ord AS person_ord, v.track_id AS vehicle_track_id, v.det_ord AS vehicle_ord,
        sqrt(power((p.x1 + p.x2) / 2 - (v.x1 + v.x2) / 2, 2) + power((p.y1 + p.y2) / 2 - (v.y1 + v.y2) / 2, 2)) / sqrt(816e0 * 816e0 + 448e0 * 448e0) AS dist_norm
        FROM per p JOIN veh v ON p.frame_idx = v.frame_idx""",
    "gated": "SELECT * FROM per p WHERE EXISTS (SELECT 1 FROM pair WHERE pair.frame_idx = p.frame_idx AND pair.person_track_id = p.track_id AND dist_norm <= 0.15e0)",
    "crop": """SELECT * FROM (SELECT *, greatest(0, CAST(trunc(x1 - (x2 - x1) * 0.4e0) AS INT)) AS cx1, greatest(0, CAST(trunc(y1 - (y2 - y1) * 0.4e0) AS INT)) AS cy1,
        least(816, CAST(trunc(x2 + (x2 - x1) * 0.4e0) AS INT)) AS cx2, least(448, CAST(trunc(y2 + (y2 - y1) * 0.4e0) AS INT)) AS cy2 FROM gated) WHERE cx2 > cx1 AND cy2 > cy1""",
    "threat": "SELECT * FROM raw WHERE confidence >= 0.4e0 AND lower(coalesce(class_name, '')) NOT IN ('person', 'hand', 'phone')",
    "best": "SELECT * FROM threat QUALIFY row_number() OVER (PARTITION BY frame_idx, person_track_id ORDER BY confidence DESC, box_ord) = 1",
    "hit": """SELECT b.frame_idx, b.person_track_id, b.confidence, c.ts_s, bx + cx1 AS hx1, bt + cy1 AS hy1, bx + 10 + cx1 AS hx2, bt + 8 + cy1 AS hy2
        FROM best b JOIN crop c ON c.frame_idx = b.frame_idx AND c.track_id = b.person_track_id""",
    "near": "SELECT * FROM pair WHERE dist_norm <= 0.15e0 QUALIFY row_number() OVER (PARTITION BY frame_idx, person_track_id ORDER BY dist_norm, vehicle_ord) = 1",
    "grp": """SELECT frame_idx, vehicle_track_id, max(confidence) AS confidence, string_agg(CAST(person_track_id AS VARCHAR), ',' ORDER BY person_ord) AS person_ids
        FROM near JOIN hit USING (frame_idx, person_track_id) GROUP BY ALL""",
    "smp": """SELECT v.frame_idx, v.ts_s, v.det_ord AS vehicle_ord, v.track_id AS vehicle_track_id, CASE WHEN g.confidence >= 0.5e0 THEN g.confidence ELSE 0e0 END AS score,
        CAST(v.track_id AS VARCHAR) || coalesce(',' || person_ids, '') AS track_ids
        FROM veh v LEFT JOIN grp g ON g.frame_idx = v.frame_idx AND g.vehicle_track_id = v.track_id""",
    "abv": """SELECT * FROM (SELECT *, max(CASE WHEN score < 0.5e0 THEN ts_s END) OVER (PARTITION BY vehicle_track_id ORDER BY ts_s, frame_idx, vehicle_ord
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_below FROM smp) WHERE score >= 0.5e0""",
    "brk": """SELECT *, CASE WHEN prev IS NULL OR coalesce(last_below - prev > {gap}, false) THEN 1 ELSE 0 END AS breaks FROM
        (SELECT *, lag(ts_s) OVER (PARTITION BY vehicle_track_id ORDER BY ts_s, frame_idx, vehicle_ord) AS prev FROM abv)""",
    "stn": "SELECT *, sum(breaks) OVER (PARTITION BY vehicle_track_id ORDER BY ts_s, frame_idx, vehicle_ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS streak FROM brk",
    "stk": """SELECT *, row_number() OVER w AS n, first_value(ts_s) OVER w AS start_ts_s, first_value(frame_idx) OVER w AS start_frame_idx, max(score) OVER w AS peak FROM stn
        WINDOW w AS (PARTITION BY vehicle_track_id, streak ORDER BY ts_s, frame_idx, vehicle_ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "cand": "SELECT *, row_number() OVER (PARTITION BY vehicle_track_id ORDER BY ts_s, frame_idx, vehicle_ord) AS r FROM stk WHERE n >= 2 AND ts_s - start_ts_s >= 0.15e0",
    "nxt": """SELECT c.vehicle_track_id, c.r, min(d.r) AS nr FROM cand c LEFT JOIN cand d ON d.vehicle_track_id = c.vehicle_track_id AND d.streak > c.streak AND d.ts_s >= c.ts_s + {cooldown}
        GROUP BY c.vehicle_track_id, c.r""",
    "chain": """SELECT vehicle_track_id, CAST(1 AS BIGINT) AS r FROM cand WHERE r = 1
        UNION ALL SELECT x.vehicle_track_id, nxt.nr FROM chain x JOIN nxt ON nxt.vehicle_track_id = x.vehicle_track_id AND nxt.r = x.r WHERE nxt.nr IS NOT NULL""",
    "evt": """SELECT c.* FROM chain JOIN cand c USING (vehicle_track_id, r)""",
}
_NEEDS = {
    "det": ["ev"], "obj": ["det"], "per": ["obj"], "veh": ["obj"], "raw": ["per", "ev"], "pair": ["per", "veh"], "gated": ["per", "pair"], "crop": ["gated"], "threat": ["raw"],
    "best": ["threat"], "hit": ["best", "crop"], "near": ["pair"], "grp": ["near", "hit"], "smp": ["veh", "grp"], "abv": ["smp"], "brk": ["abv"], "stn": ["brk"], "stk": ["stn"],
    "cand": ["stk"], "nxt": ["cand"], "chain": ["nxt"], "evt": ["chain"],
}


def _with(select: str, *names: str, gap: str = "0.15e0", cooldown: str = "5e0") -> str:
    order: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    body = ",\n".join(f"{n} AS ({_CTE[n].replace('{gap}', gap).replace('{cooldown}', cooldown)})" for n in order)
    return f"WITH RECURSIVE {body}\n{select}"


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def plan(spark: SparkSession, sf_dir: str) -> Detections:
    return Detections(T.objects(spark, sf_dir), T.weapon_raw(spark, sf_dir))


def joined_ids(c: str = "track_ids") -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query("""SELECT DISTINCT event_id // 12 AS frame_idx, round((event_id // 12) / 15e0, 6) AS ts_s FROM events WHERE (event_id // 12) % 3 = 0""")
def q_frame_stride(spark, sf_dir):
    return detect.timestamps(detect.stride(T.frames(spark, sf_dir), 3)).select("frame_idx", r6("ts_s").alias("ts_s"))


@query(_with("SELECT CASE WHEN class_id = 0 THEN 'person' ELSE 'vehicle' END AS cls, count(*) AS n, CAST(sum(track_id) AS BIGINT) AS sum_track FROM det WHERE class_id IN (0,2,3,5,7) AND confidence >= 0.35e0 GROUP BY 1", "det"))
def q_class_map(spark, sf_dir):
    return detect.objects(T.detector_rows(spark, sf_dir)).groupBy("cls").agg(F.count("*").alias("n"), F.sum("track_id").alias("sum_track"))


@query(_with("SELECT frame_idx, track_id, round((x1 + x2) / 2, 6) AS cx, round((y1 + y2) / 2, 6) AS cy, round(sqrt(816e0 * 816e0 + 448e0 * 448e0), 6) AS diag FROM obj", "obj"))
def q_centroid_diag(spark, sf_dir):
    cx, cy = G.centre(F.col("bbox"))
    return T.objects(spark, sf_dir).select("frame_idx", "track_id", r6(cx).alias("cx"), r6(cy).alias("cy"), r6(G.diagonal(F.col("width"), F.col("height"))).alias("diag"))


@query(_with("SELECT frame_idx, track_id FROM gated", "gated"))
def q_gate_semi(spark, sf_dir):
    d = plan(spark, sf_dir)
    return gate.gated(d.persons, d.vehicles).select("frame_idx", "track_id")


@query(_with("SELECT frame_idx, track_id FROM per p WHERE NOT EXISTS (SELECT 1 FROM pair WHERE pair.frame_idx = p.frame_idx AND pair.person_track_id = p.track_id AND dist_norm <= 0.15e0)", "pair"))
def q_gate_anti(spark, sf_dir):
    d = plan(spark, sf_dir)
    return gate.not_gated(d.persons, d.vehicles).select("frame_idx", "track_id")


@query(_with("SELECT frame_idx, person_track_id, vehicle_track_id, round(dist_norm, 6) AS dist_norm FROM near", "near"))
def q_nearest_gated(spark, sf_dir):
    return plan(spark, sf_dir).nearest.select("frame_idx", "person_track_id", "vehicle_track_id", r6("dist_norm").alias("dist_norm"))


@query(_with("SELECT p.frame_idx, p.track_id AS person_track_id, round(min(dist_norm), 6) AS dist_norm FROM per p LEFT JOIN pair ON pair.frame_idx = p.frame_idx AND pair.person_track_id = p.track_id GROUP BY 1, 2", "pair"))
def q_nearest_left(spark, sf_dir):
    d = plan(spark, sf_dir)
    return gate.nearest_any(d.persons, d.vehicles).select("frame_idx", "person_track_id", r6("dist_norm").alias("dist_norm"))


@query(_with("SELECT frame_idx, track_id, cx1, cy1, cx2, cy2 FROM crop", "crop"))
def q_crop_window(spark, sf_dir):
    return plan(spark, sf_dir).crops.select("frame_idx", "track_id", "window.*")


@query(_with("SELECT frame_idx, person_track_id, round(confidence, 6) AS confidence, CAST(hx1 AS DOUBLE) AS x1, CAST(hy1 AS DOUBLE) AS y1, CAST(hx2 AS DOUBLE) AS x2, CAST(hy2 AS DOUBLE) AS y2 FROM hit", "hit"))
def q_crop_to_frame(spark, sf_dir):
    return plan(spark, sf_dir).hits.select("frame_idx", "person_track_id", r6("confidence").alias("confidence"), "bbox.*")


@query(_with("SELECT frame_idx, person_track_id, box_ord, coalesce(class_name, '') AS class_name, round(confidence, 6) AS confidence FROM threat", "threat"))
def q_threat_filter(spark, sf_dir):
    return detect.threats(T.weapon_raw(spark, sf_dir)).select("frame_idx", "person_track_id", "box_ord", F.coalesce("class_name", F.lit("")).alias("class_name"), r6("confidence").alias("confidence"))


@query(_with("SELECT frame_idx, person_track_id, box_ord, round(confidence, 6) AS confidence FROM best", "best"))
def q_best_threat(spark, sf_dir):
    return detect.best_threat(detect.threats(T.weapon_raw(spark, sf_dir))).select("frame_idx", "person_track_id", "box_ord", r6("confidence").alias("confidence"))


@query(_with("SELECT frame_idx, person_track_id, box_ord, row_number() OVER (PARTITION BY frame_idx, person_track_id ORDER BY confidence DESC, box_ord) AS rank FROM raw", "raw"))
def q_boxes_ranked(spark, sf_dir):
    return detect.ranked(T.weapon_raw(spark, sf_dir)).select("frame_idx", "person_track_id", "box_ord", F.col("rank").cast("long").alias("rank"))


@query(_with("SELECT box_ord, CASE WHEN (box_ord // 5) % 5 < 3 THEN ['person', 'weapon', 'phone'][(box_ord // 5) % 5 + 1] ELSE CAST((box_ord // 5) % 5 AS VARCHAR) END AS class_name, count(*) AS n FROM raw GROUP BY 1, 2", "raw"))
def q_class_names(spark, sf_dir):
    boxes = T.weapon_raw(spark, sf_dir).drop("class_name").withColumn("class_id", F.expr("(box_ord div 5) % 5").cast("int"))
    names = labels.class_names(spark, {"7": "weapon", "2": "person", "9": "phone"})
    return detect.named(boxes, names, F.col("class_id").cast("string")).groupBy("box_ord", "class_name").agg(F.count("*").alias("n"))


@query(_with("SELECT frame_idx, vehicle_track_id, round(confidence, 6) AS confidence, person_ids FROM grp", "grp"))
def q_hits_by_vehicle(spark, sf_dir):
    return plan(spark, sf_dir).by_vehicle.select("frame_idx", "vehicle_track_id", r6("confidence").alias("confidence"), joined_ids("person_ids").alias("person_ids"))


@query(_with("SELECT frame_idx, vehicle_track_id, round(ts_s, 6) AS ts_s, round(score, 6) AS score, track_ids FROM smp", "smp"))
def q_samples(spark, sf_dir):
    return plan(spark, sf_dir).samples.select("frame_idx", "vehicle_track_id", r6("ts_s").alias("ts_s"), r6("score").alias("score"), joined_ids().alias("track_ids"))


@query(_with("SELECT frame_idx, vehicle_track_id, CAST(streak AS BIGINT) AS streak, n, round(start_ts_s, 6) AS start_ts_s, round(peak, 6) AS peak FROM stk", "stk"))
def q_streaks(spark, sf_dir):
    s = debounce.streaks(plan(spark, sf_dir).samples)
    return s.select("frame_idx", "vehicle_track_id", "streak", F.col("n").cast("long").alias("n"), r6("start_ts_s").alias("start_ts_s"), r6("peak").alias("peak"))


@query(_with("SELECT frame_idx, vehicle_track_id, CAST(streak AS BIGINT) AS streak, round(peak, 6) AS peak FROM cand", "cand"))
def q_candidates(spark, sf_dir):
    return debounce.candidates(debounce.streaks(plan(spark, sf_dir).samples)).select("frame_idx", "vehicle_track_id", "streak", r6("peak").alias("peak"))


_EVENTS = "SELECT 'weapon' AS event_type, round(start_ts_s, 6) AS start_timestamp_s, round(ts_s, 6) AS end_timestamp_s, start_frame_idx, frame_idx AS end_frame_idx, round(peak, 6) AS peak_score, track_ids FROM evt"


def _event_columns(e: DataFrame) -> DataFrame:
    return e.select("event_type", r6("start_timestamp_s").alias("start_timestamp_s"), r6("end_timestamp_s").alias("end_timestamp_s"), "start_frame_idx", "end_frame_idx", r6("peak_score").alias("peak_score"), joined_ids().alias("track_ids"))


@query(_with(_EVENTS, "evt"))
def q_events(spark, sf_dir):
    return _event_columns(plan(spark, sf_dir).events)


@query(_with(_EVENTS, "evt", gap="0.3e0", cooldown="1e0"))
def q_events_short_cooldown(spark, sf_dir):
    return _event_columns(debounce.debounce(plan(spark, sf_dir).samples, debounce.Thresholds(cooldown_s=1.0, max_gap_s=0.3)))


@query(_with("SELECT 'clip0' AS clip_id, row_number() OVER (ORDER BY start_ts_s, ts_s, vehicle_track_id) AS place, round(start_ts_s, 6) AS start_timestamp_s, track_ids FROM evt", "evt"))
def q_events_sorted(spark, sf_dir):
    return sinks.numbered(plan(spark, sf_dir).events).select("clip_id", "place", r6("start_timestamp_s").alias("start_timestamp_s"), joined_ids().alias("track_ids"))


@query(_with("SELECT f.frame_idx, string_agg(DISTINCT 'RISK: weapon', chr(10)) AS banner FROM (SELECT DISTINCT frame_idx, frame_idx / 15e0 AS ts_s FROM ev) f JOIN evt ON evt.ts_s <= f.ts_s AND evt.ts_s >= f.ts_s - 3e0 GROUP BY 1", "ev", "evt"))
def q_active_banner(spark, sf_dir):
    return analysis.active_banner(detect.timestamps(T.frames(spark, sf_dir)), plan(spark, sf_dir).events).select("frame_idx", "banner")


@query(_with("SELECT (SELECT count(DISTINCT frame_idx) FROM ev) AS n_frames, count(*) AS n_hits, count(*) FILTER (confidence >= 0.5e0) AS n_above, round(max(confidence), 6) AS max_confidence FROM hit", "ev", "hit"))
def q_hit_summary(spark, sf_dir):
    return analysis.hit_summary(plan(spark, sf_dir).hits, T.frames(spark, sf_dir), 0.5).withColumn("max_confidence", r6("max_confidence"))


def _timed(hits: DataFrame) -> DataFrame:
    return hits.withColumn("ts_s", F.col("frame_idx") / F.lit(T.FPS))


@query(_with("""SELECT 'clip0' AS clip_id, round(coalesce(max(len), 0), 6) AS longest_run_s FROM (SELECT max(ts_s) - min(ts_s) AS len FROM (SELECT ts_s, sum(g) OVER (ORDER BY ts_s) AS run FROM
(SELECT ts_s, CASE WHEN ts_s - lag(ts_s) OVER (ORDER BY ts_s) > 0.15e0 THEN 1 ELSE 0 END AS g FROM (SELECT DISTINCT ts_s FROM hit WHERE confidence >= 0.5e0))) GROUP BY run)""", "hit"))
def q_longest_run_stream(spark, sf_dir):
    """The longest run from a stream's session windows."""
    from lanternflow.streaming.runs import replay_longest

    return replay_longest(_timed(plan(spark, sf_dir).hits), 0.5, 0.15).withColumn("longest_run_s", r6("longest_run_s"))


@query(_with("""SELECT 'clip0' AS clip_id, round(coalesce(max(len), 0), 6) AS longest_run_s FROM (SELECT max(ts_s) - min(ts_s) AS len FROM (SELECT ts_s, sum(g) OVER (ORDER BY ts_s) AS run FROM
(SELECT ts_s, CASE WHEN ts_s - lag(ts_s) OVER (ORDER BY ts_s) > 0.15e0 THEN 1 ELSE 0 END AS g FROM (SELECT DISTINCT ts_s FROM hit WHERE confidence >= 0.5e0))) GROUP BY run)""", "hit"))
def q_longest_run(spark, sf_dir):
    return analysis.longest_run(_timed(plan(spark, sf_dir).hits), 0.5, 0.15).withColumn("longest_run_s", r6("longest_run_s"))


_SPACED = """, ord AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, ts_s, frame_idx, person_track_id) AS r FROM hit WHERE confidence >= 0.5e0),
pick AS (SELECT CAST(0 AS BIGINT) AS r, CAST([] AS DOUBLE[]) AS ts, CAST([] AS BIGINT[]) AS rs
  UNION ALL SELECT o.r, CASE WHEN len(ts) < 50 AND len(list_filter(ts, lambda y: abs(y - o.ts_s) < 0.3e0)) = 0 THEN list_append(ts, o.ts_s) ELSE ts END,
    CASE WHEN len(ts) < 50 AND len(list_filter(ts, lambda y: abs(y - o.ts_s) < 0.3e0)) = 0 THEN list_append(rs, o.r) ELSE rs END FROM pick JOIN ord o ON o.r = pick.r + 1),
chosen AS (SELECT o.* FROM ord o WHERE o.r IN (SELECT unnest(rs) FROM pick WHERE r = (SELECT max(r) FROM pick)))
"""


def _spaced(spark, sf_dir):
    hits = _timed(plan(spark, sf_dir).hits).withColumn("ord", F.col("frame_idx") * 1_000_000 + F.col("person_track_id"))
    return analysis.spaced_top(hits, 50, 0.3, 0.5)


@query(_with(_SPACED.lstrip(",\n "), "hit").replace(")\nord AS", "),\nord AS") + "SELECT frame_idx, person_track_id, round(confidence, 6) AS confidence FROM chosen")
def q_topk_spaced(spark, sf_dir):
    return _spaced(spark, sf_dir).select("frame_idx", "person_track_id", r6("confidence").alias("confidence"))


@query(_with(_SPACED.lstrip(",\n "), "hit").replace(")\nord AS", "),\nord AS") + """SELECT printf('frame%05d_t%.2fs_conf%.2f', frame_idx, ts_s, confidence) AS name, frame_idx, person_track_id, round(ts_s, 2) AS ts_s, greatest(0, hx1 - 10) AS cx1, greatest(0, hy1 - 8) AS cy1, least(816, hx2 + 10) AS cx2, least(448, hy2 + 8) AS cy2,
  round(px1, 6) AS px1 FROM chosen JOIN (SELECT frame_idx, track_id AS person_track_id, x1 AS px1 FROM per) USING (frame_idx, person_track_id)""")
def q_snapshot_manifest(spark, sf_dir):
    d = plan(spark, sf_dir)
    chosen = _spaced(spark, sf_dir).select("clip_id", "frame_idx", "ts_s", "person_track_id").join(d.hits, ["clip_id", "frame_idx", "person_track_id"])
    chosen = annotate.hit_boxes(chosen, d.persons).withColumns({"width": F.lit(T.WIDTH), "height": F.lit(T.HEIGHT)})
    m = annotate.snapshot_manifest(chosen)
    cut = {k: F.col(f"window.{k}").cast("long") for k in ("cx1", "cy1", "cx2", "cy2")}
    return m.select("name", "frame_idx", "person_track_id", F.round("ts_s", 2).alias("ts_s"), *[c.alias(k) for k, c in cut.items()], r6("person_bbox.x1").alias("px1"))


@query("SELECT DISTINCT event_id // 12 AS frame_idx FROM events WHERE (event_id // 12) % 100 = 0")
def q_progress(spark, sf_dir):
    return analysis.progress(T.frames(spark, sf_dir)).select("frame_idx")


@query(_with("""SELECT frame_idx, 'track' AS kind, track_id, CAST(trunc(x1) AS INT) AS x1, CAST(trunc(y1) AS INT) AS y1, CAST(trunc(x2) AS INT) AS x2, CAST(trunc(y2) AS INT) AS y2,
  CASE WHEN class_id = 0 THEN '0,220,0' ELSE '0,140,255' END AS colour, printf('%s#%d %.2f', CASE WHEN class_id = 0 THEN 'person' ELSE 'vehicle' END, track_id, confidence) AS label FROM obj
  UNION ALL SELECT frame_idx, 'weapon', person_track_id, CAST(hx1 AS INT), CAST(hy1 AS INT), CAST(hx2 AS INT), CAST(hy2 AS INT), '0,0,255', printf('weapon %.2f', confidence) FROM hit""", "hit"))
def q_annotations(spark, sf_dir):
    d = plan(spark, sf_dir)
    return annotate.track_boxes(d.objects).unionByName(annotate.weapon_boxes(d.hits)).drop("clip_id")


@query(_with("""SELECT frame_idx, 'RISK: weapon' AS line, CAST(24 AS INT) AS y FROM (SELECT DISTINCT frame_idx, frame_idx / 15e0 AS ts_s FROM ev) f
  WHERE EXISTS (SELECT 1 FROM evt WHERE evt.ts_s <= f.ts_s AND evt.ts_s >= f.ts_s - 3e0)""", "ev", "evt"))
def q_banner_lines(spark, sf_dir):
    banner = analysis.active_banner(detect.timestamps(T.frames(spark, sf_dir)), plan(spark, sf_dir).events)
    return annotate.banner_lines(banner).drop("clip_id")


_LABELS = """WITH lines AS (
  SELECT CASE o_orderstatus WHEN 'F' THEN 'cctv_v3' WHEN 'P' THEN 'gun_cctv' ELSE 'pistols' END AS source,
    CASE WHEN o_orderkey % 10 <= 7 THEN 'train' WHEN o_orderkey % 10 = 8 THEN 'valid' ELSE 'test' END AS split,
    'img' || (o_orderkey // 3) AS image_stem, CAST(o_orderkey % 3 AS INT) AS line_no, o_orderkey // 3 AS stem_n,
    (o_custkey % 3) || ' 0.' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || ' 0.' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') || ' 0.' ||
    lpad(CAST((o_orderkey * 7) % 500 + 1 AS VARCHAR), 3, '0') || ' 0.' || lpad(CAST((o_custkey * 11 + o_orderkey) % 500 + 1 AS VARCHAR), 3, '0') AS line FROM orders
), parsed AS (
  SELECT *, CAST(p[1] AS INT) AS class_idx, CAST(p[2] AS DOUBLE) AS cx, CAST(p[3] AS DOUBLE) AS cy, CAST(p[4] AS DOUBLE) AS w, CAST(p[5] AS DOUBLE) AS h
  FROM (SELECT *, string_split_regex(trim(line), '\\s+') AS p FROM lines) WHERE trim(line) <> ''
), mapped AS (SELECT *, CASE class_idx WHEN 1 THEN 0 WHEN 2 THEN 1 END AS target_idx FROM parsed WHERE class_idx <> 0
), capped AS (SELECT * FROM mapped WHERE NOT (target_idx = 0 AND w * h > 0.02e0)
), boxes AS (SELECT *, split_part(source || '_' || image_stem, '_', 1) AS source_group, source || '_' || image_stem AS name, greatest(w, h) / greatest(least(w, h), 1e-9) AS aspect, w * h AS area FROM parsed WHERE class_idx = 1
), stems AS (SELECT DISTINCT source, split, image_stem, stem_n AS n FROM lines
), images AS (
  SELECT source, split, image_stem, n, CASE n % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.jpeg' ELSE '.png' END AS ext FROM stems WHERE n % 5 <> 0
  UNION SELECT source, split, image_stem, n, '.png' FROM stems WHERE n % 5 <> 0 AND n % 7 = 0
  UNION ALL SELECT source, split, image_stem || 'x', n, '.jpg' FROM stems WHERE n % 11 = 0
)
"""
_NAMES, _MAP, _TARGETS, _CAPS = ["person", "weapon", "knife"], {"person": None, "weapon": "threat", "knife": "blade"}, ["threat", "blade"], {0: 0.02}


@query(_LABELS + "SELECT source, split, image_stem, line_no, class_idx, round(cx, 6) AS cx, round((cx - w / 2) * 640, 6) AS x1, round((cy + h / 2) * 480, 6) AS y2, round(w * h, 6) AS area FROM parsed WHERE class_idx = 1")
def q_labels_parse(spark, sf_dir):
    p = labels.parse(T.label_lines(spark, sf_dir)).where("class_idx = 1")
    box = G.pixels(F.col("cx"), F.col("cy"), F.col("w_norm"), F.col("h_norm"), F.lit(640), F.lit(480))
    return p.select("source", "split", "image_stem", "line_no", "class_idx", r6("cx").alias("cx"), r6(box["x1"]).alias("x1"), r6(box["y2"]).alias("y2"), r6(F.col("w_norm") * F.col("h_norm")).alias("area"))


def _remapped(spark, sf_dir):
    return labels.remap(labels.parse(T.label_lines(spark, sf_dir)), labels.class_remap(_NAMES, _MAP, _TARGETS))


@query(_LABELS + "SELECT source, split, image_stem, line_no, class_idx, target_idx FROM mapped")
def q_class_remap(spark, sf_dir):
    return _remapped(spark, sf_dir).select("source", "split", "image_stem", "line_no", "class_idx", "target_idx")


@query(_LABELS + "SELECT source, split, image_stem, line_no, target_idx, round(w * h, 6) AS area FROM capped")
def q_area_cap(spark, sf_dir):
    return labels.area_cap(_remapped(spark, sf_dir), _CAPS).select("source", "split", "image_stem", "line_no", "target_idx", r6(F.col("w_norm") * F.col("h_norm")).alias("area"))


@query(_LABELS + "SELECT source, split, source || '_' || image_stem AS image_stem, line_no, target_idx || substr(line, 2) AS line FROM capped")
def q_merge_union(spark, sf_dir):
    lines, mapping = T.label_lines(spark, sf_dir), labels.class_remap(_NAMES, _MAP, _TARGETS)
    return labels.merge([(s, lines.where(F.col("source") == s), mapping, _CAPS) for s in T.SOURCES.values()])


@query(_LABELS + "SELECT coalesce(split, 'all') AS split, coalesce(source, 'all') AS source, count(*) AS n_images FROM images GROUP BY ROLLUP (split, source)")
def q_split_counts(spark, sf_dir):
    return labels.split_counts(T.images(spark, sf_dir)).select(F.coalesce("split", F.lit("all")).alias("split"), F.coalesce("source", F.lit("all")).alias("source"), "n_images")


def _boxes(spark, sf_dir):
    p = labels.parse(T.label_lines(spark, sf_dir)).where("class_idx = 1")
    return labels.boxes(p.withColumn("image_stem", F.concat_ws("_", "source", "image_stem")))


@query(_LABELS + "SELECT source_group, count(*) AS n FROM boxes GROUP BY 1")
def q_label_groups(spark, sf_dir):
    return _boxes(spark, sf_dir).groupBy("source_group").agg(F.count("*").alias("n"))


_STATS = ", ".join(f"round(median({c}), 6) AS median_{n}, round(avg({c}), 6) AS mean_{n}" for c, n in (("w", "width"), ("h", "height"), ("aspect", "aspect"), ("area", "area")))


@query(_LABELS + f"SELECT source_group, count(*) AS n, {_STATS}, round(max(aspect), 6) AS max_aspect FROM boxes GROUP BY 1")
def q_box_stats(spark, sf_dir):
    s = labels.box_stats(_boxes(spark, sf_dir))
    return s.select("source_group", "n", *[r6(c).alias(c) for c in s.columns[2:]])


@query(_LABELS + "SELECT source_group, name AS image_stem, line_no, round(aspect, 6) AS aspect, row_number() OVER (PARTITION BY source_group ORDER BY aspect DESC, name, line_no) AS rank FROM boxes QUALIFY rank <= 10")
def q_most_elongated(spark, sf_dir):
    return labels.most_elongated(_boxes(spark, sf_dir), 10).select("source_group", "image_stem", "line_no", r6("aspect").alias("aspect"), F.col("rank").cast("long").alias("rank"))


@query(_LABELS + "SELECT source_group, name AS image_stem, line_no FROM boxes QUALIFY row_number() OVER (PARTITION BY source_group ORDER BY md5('0#' || name || '#' || line_no), name, line_no) <= 20")
def q_label_sample(spark, sf_dir):
    return labels.sample(_boxes(spark, sf_dir), 20).select("source_group", "image_stem", "line_no")


@query(_LABELS + "SELECT i.source, i.split, i.image_stem, i.ext, coalesce(l.line_no, -1) AS line_no, coalesce(l.line, '') AS line FROM images i LEFT JOIN lines l USING (source, split, image_stem)")
def q_image_label_left(spark, sf_dir):
    found = labels.image_labels(T.images(spark, sf_dir), T.label_lines(spark, sf_dir))
    return found.select("source", "split", "image_stem", "ext", F.coalesce("line_no", F.lit(-1)).alias("line_no"), F.coalesce("line", F.lit("")).alias("line"))


@query(_LABELS + """SELECT l.source, l.split, l.image_stem, l.line_no, i.ext FROM lines l JOIN (SELECT * FROM images QUALIFY row_number() OVER (PARTITION BY source, split, image_stem
  ORDER BY list_position(['.jpg', '.jpeg', '.png'], ext)) = 1) i USING (source, split, image_stem)""")
def q_image_label_inner(spark, sf_dir):
    return labels.labels_with_image(T.label_lines(spark, sf_dir), T.images(spark, sf_dir)).select("source", "split", "image_stem", "line_no", "ext")


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS digest FROM documents")
def q_digest(spark, sf_dir):
    from lanternflow.sources.files import digest

    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", digest(F.col("text").cast("binary")).alias("digest"))


_METRICS = """WITH m AS (SELECT 'c' || (doc_id % 3) AS class_name,
  CAST(count(*) FILTER (quality = 1 AND toxic = 0) AS DOUBLE) / greatest(count(*) FILTER (toxic = 0), 1) AS "precision",
  CAST(count(*) FILTER (quality = 1 AND toxic = 0) AS DOUBLE) / greatest(count(*) FILTER (quality = 1), 1) AS recall FROM labels GROUP BY 1),
f AS (SELECT class_name, 'precision' AS metric, "precision" AS value FROM m UNION ALL SELECT class_name, 'recall', recall FROM m)
SELECT class_name, metric, round(value, 6) AS value FROM f UNION ALL SELECT 'all', metric, round(avg(value), 6) FROM f GROUP BY metric"""


def _per_class(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/labels.parquet")
    both = F.sum(F.expr("CAST(quality = 1 AND toxic = 0 AS DOUBLE)"))
    return t.groupBy(F.concat(F.lit("c"), (F.col("doc_id") % 3).cast("string")).alias("class_name")).agg(
        (both / F.greatest(F.sum(F.expr("CAST(toxic = 0 AS DOUBLE)")), F.lit(1.0))).alias("precision"), (both / F.greatest(F.sum(F.expr("CAST(quality = 1 AS DOUBLE)")), F.lit(1.0))).alias("recall")
    )


@query(_METRICS)
def q_metrics_flat(spark, sf_dir):
    return analysis.metrics_long(_per_class(spark, sf_dir)).withColumn("value", r6("value"))


@query(_with("""SELECT round(min(dist_norm), 6) AS min_distance_norm, round(max((vehicle_ord % 13) - 20e0), 6) AS max_approach_speed_px_s, round(greatest(0, max((person_ord % 97) / 10e0)), 6) AS max_dwell_time_s,
  round(greatest(0, max((person_ord % 31) / 10e0)), 6) AS max_close_dwell_time_s, round(greatest(0, max(dist_norm - 2)), 6) AS max_struggle_score, round(greatest(0, max(dist_norm)), 6) AS max_sprint_score,
  0e0 AS max_weapon_score, count(DISTINCT frame_idx) AS frames_with_pair, (SELECT count(DISTINCT frame_idx) FROM ev) AS frames_total, (SELECT count(DISTINCT frame_idx) FROM per) AS person_frames,
  (SELECT count(DISTINCT frame_idx) FROM veh) AS vehicle_frames FROM pair""", "ev", "pair"))
def q_signal_extremes(spark, sf_dir):
    d = plan(spark, sf_dir)
    pairs = d.persons.join(gate._vehicles(d.vehicles), ["clip_id", "frame_idx"]).select(
        "clip_id", "frame_idx", G.distance_norm(F.col("bbox"), F.col("vehicle_bbox"), G.diagonal(F.col("width"), F.col("height"))).alias("person_vehicle_distance_norm"),
        ((F.col("vehicle_ord") % 13) - F.lit(20.0)).alias("approach_speed_px_s"), ((F.col("det_ord") % 97) / F.lit(10.0)).alias("dwell_time_s"), ((F.col("det_ord") % 31) / F.lit(10.0)).alias("close_dwell_time_s"),
    )
    pairs = pairs.withColumns({"struggle_score": F.col("person_vehicle_distance_norm") - 2, "sprint_score": F.col("person_vehicle_distance_norm"), "weapon_score": F.lit(None).cast("double")})
    out = analysis.signal_extremes(pairs, analysis.presence(T.frames(spark, sf_dir), d.objects))
    return out.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query(_with("SELECT count(*) AS n_events FROM evt", "evt"))
def q_event_count(spark, sf_dir):
    return plan(spark, sf_dir).events.agg(F.count("*").alias("n_events"))


@query(_with("SELECT frame_idx, person_track_id, round(px1, 6) AS px1 FROM hit LEFT JOIN (SELECT frame_idx, track_id AS person_track_id, x1 AS px1 FROM per) USING (frame_idx, person_track_id)", "hit"))
def q_hit_boxes(spark, sf_dir):
    d = plan(spark, sf_dir)
    return annotate.hit_boxes(d.hits, d.persons).select("frame_idx", "person_track_id", r6("person_bbox.x1").alias("px1"))


@query(_with("SELECT frame_idx, track_id, round(confidence, 6) AS confidence FROM obj WHERE frame_idx = 20", "obj"))
def q_frame_at(spark, sf_dir):
    from lanternflow.sources.files import frame_at

    return frame_at(T.objects(spark, sf_dir), seconds=20.4 / 15.0, fps=T.FPS).select("frame_idx", "track_id", r6("confidence").alias("confidence"))


@query(_with("SELECT frame_idx, person_track_id, round(ts_s, 6) AS ts_s, confidence >= 0.5e0 AS above FROM hit", "hit"))
def q_hit_lines(spark, sf_dir):
    return annotate.hit_lines(_timed(plan(spark, sf_dir).hits), 0.5).select("frame_idx", "person_track_id", r6("ts_s").alias("ts_s"), "above")


@query(_with("SELECT p.frame_idx, p.person_track_id, p.vehicle_track_id, coalesce(round(h.confidence, 6), -1) AS weapon_confidence FROM pair p LEFT JOIN hit h USING (frame_idx, person_track_id)", "pair", "hit"))
def q_pair_hits(spark, sf_dir):
    d = plan(spark, sf_dir)
    pairs = d.persons.join(gate._vehicles(d.vehicles), ["clip_id", "frame_idx"]).select("clip_id", "frame_idx", F.col("track_id").alias("person_track_id"), "vehicle_track_id")
    return analysis.attach_hits(pairs, d.hits).select("frame_idx", "person_track_id", "vehicle_track_id", F.coalesce(r6("weapon_confidence"), F.lit(-1.0)).alias("weapon_confidence"))


@query(_with("SELECT f.frame_idx, EXISTS (SELECT 1 FROM per WHERE per.frame_idx = f.frame_idx) AS has_person, EXISTS (SELECT 1 FROM veh WHERE veh.frame_idx = f.frame_idx) AS has_vehicle FROM (SELECT DISTINCT frame_idx FROM ev) f", "ev", "per", "veh"))
def q_presence(spark, sf_dir):
    return analysis.presence(T.frames(spark, sf_dir), T.objects(spark, sf_dir)).select("frame_idx", "has_person", "has_vehicle")


@query(_with("SELECT frame_idx, person_track_id, box_ord FROM raw WHERE lower(coalesce(class_name, '')) <> 'person'", "raw"))
def q_drawable_boxes(spark, sf_dir):
    return annotate.drawable(T.weapon_raw(spark, sf_dir)).select("frame_idx", "person_track_id", "box_ord")


@query(_with(_EVENTS, "evt"))
def q_events_segments(spark, sf_dir):
    """The events with every key cut to slots; no task holds a key."""
    from lanternflow.operators import segments

    return _event_columns(segments.debounce(plan(spark, sf_dir).samples))


@query(_with(_EVENTS, "evt"))
def q_stream_flagship(spark, sf_dir):
    """The events from streams of raw detections and boxes, in disorder, with two restarts."""
    from lanternflow.streaming.flagship import replay

    objects = T.detector_rows(spark, sf_dir).withColumn("cls", detect.class_of(F.col("class_id")))
    boxes = T.weapon_raw(spark, sf_dir).withColumn("ts_s", F.col("frame_idx") / F.lit(T.FPS))
    return _event_columns(replay(objects, boxes, stops=2))


@query(_with(_EVENTS, "evt"))
def q_events_stream(spark, sf_dir):
    from lanternflow.streaming.debounce import replay

    return _event_columns(replay(plan(spark, sf_dir).samples))


@query(_with("""SELECT f.frame_idx, 'RISK: weapon' AS line FROM (SELECT DISTINCT frame_idx, frame_idx / 15e0 AS ts_s FROM ev) f
  WHERE EXISTS (SELECT 1 FROM evt WHERE evt.ts_s <= f.ts_s AND evt.ts_s >= f.ts_s - 3e0)""", "ev", "evt"))
def q_banner_stream(spark, sf_dir):
    from lanternflow.streaming.debounce import replay_banner

    return replay_banner(detect.timestamps(T.frames(spark, sf_dir)), plan(spark, sf_dir).events).select("frame_idx", "line")


@query(_with("SELECT CASE WHEN class_id = 0 THEN 'person' ELSE 'vehicle' END AS cls, count(*) AS n, CAST(sum(track_id) AS BIGINT) AS sum_track FROM det WHERE confidence >= 0.35e0 AND det_ord % 7 <> 0 GROUP BY 1", "det"))
def q_untracked(spark, sf_dir):
    rows = T.detector_rows(spark, sf_dir).withColumn("track_id", F.when(F.col("det_ord") % 7 != 0, F.col("track_id")))
    return detect.objects(rows).groupBy("cls").agg(F.count("*").alias("n"), F.sum("track_id").alias("sum_track"))


@query(_LABELS + "SELECT source, split, source || '_' || image_stem AS image_stem, line_no, target_idx || substr(line, 2) || CASE WHEN line_no = 1 THEN ' 0.9 x' ELSE '' END AS line FROM capped")
def q_trailing_fields(spark, sf_dir):
    extra = F.when(F.col("line_no") == 1, F.concat(F.lit("  "), "line", F.lit("  0.9 x "))).otherwise(F.col("line"))
    lines, mapping = T.label_lines(spark, sf_dir).withColumn("line", extra), labels.class_remap(_NAMES, _MAP, _TARGETS)
    return labels.merge([(s, lines.where(F.col("source") == s), mapping, _CAPS) for s in T.SOURCES.values()])


@query(_LABELS + "SELECT source_group, printf('%03d_ar%.1f_%s', rank, aspect, name) AS name FROM (SELECT *, row_number() OVER (PARTITION BY source_group ORDER BY aspect DESC, name, line_no) AS rank FROM boxes) WHERE rank <= 10")
def q_export_names(spark, sf_dir):
    return annotate.export_names(labels.most_elongated(_boxes(spark, sf_dir), 10), "rank").select("source_group", "name")


@query(_METRICS.split("\nSELECT class_name")[0].rsplit(",\nf AS", 1)[0] + """
SELECT class_name, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(avg("precision") OVER (), 6) AS mean_precision, round(avg(recall) OVER (), 6) AS mean_recall FROM m""")
def q_metrics_map(spark, sf_dir):
    m = analysis.metrics_map(_per_class(spark, sf_dir)).select(F.col("precision").alias("mean_precision"), F.col("recall").alias("mean_recall"), F.explode("per_class").alias("class_name", "own"))
    return m.select("class_name", r6("own.precision").alias("precision"), r6("own.recall").alias("recall"), r6("mean_precision").alias("mean_precision"), r6("mean_recall").alias("mean_recall"))


@query(_with("SELECT 'weapon' AS event_type, round(start_ts_s, 6) AS start_timestamp_s, round(ts_s, 6) AS end_timestamp_s, start_frame_idx, frame_idx AS end_frame_idx, round(peak, 6) AS peak_score, track_ids FROM evt", "evt"))
def q_events_csv(spark, sf_dir):
    return sinks.events_csv(plan(spark, sf_dir).events).withColumns({c: r6(c) for c in ("start_timestamp_s", "end_timestamp_s", "peak_score")})


@query(_with("SELECT printf('weapon at %.2fs-%.2fs, peak %.2f', start_ts_s, ts_s, peak) AS line FROM evt", "evt"))
def q_event_lines(spark, sf_dir):
    return sinks.event_log_lines(plan(spark, sf_dir).events)


@query(
    """SELECT 'clip0' AS clip_id, frame_idx, round(frame_idx / 15e0, 6) AS ts_s
    FROM (SELECT unnest(range(0, n, 3)) AS frame_idx FROM (SELECT max(event_id // 12) + 1 AS n FROM events))"""
)
def q_clip_frames(spark, sf_dir):
    from lanternflow.sources.files import clip_frames

    clips = T.frames(spark, sf_dir).groupBy("clip_id").agg((F.max("frame_idx") + 1).alias("frame_count"), F.max("fps").alias("fps"))
    return clip_frames(clips, 3).select("clip_id", "frame_idx", r6("ts_s").alias("ts_s"))


@query(_with("""SELECT min(frame_idx) AS first_frame, max(frame_idx) AS last_frame, count(*) AS n
  FROM (SELECT *, sum(CASE WHEN frame_idx - before <= 1 THEN 0 ELSE 1 END) OVER (ORDER BY frame_idx, det_ord) AS track
    FROM (SELECT frame_idx, det_ord, lag(frame_idx) OVER (ORDER BY frame_idx, det_ord) AS before FROM det WHERE class_id = 2 AND confidence >= 0.35e0)) GROUP BY track""", "det"))
def q_tracks(spark, sf_dir):
    """The tracker hook with the plainest tracker: vehicles seen without a frame between are one track."""
    from lanternflow.operators.tracking import ByValue, tracked

    rows = T.detector_rows(spark, sf_dir).where((F.col("class_id") == 2) & (F.col("confidence") >= DEFAULT.conf))
    found = tracked(rows, lambda: ByValue("class_id", 1), forgets_after=1)
    return found.groupBy("track_id").agg(F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"), F.count("*").alias("n")).drop("track_id")


@query(_with("""SELECT count(*) AS late_rows FROM (SELECT CAST(trunc((frame_idx / 15e0 + 86400) * 1000000) AS BIGINT) AS us FROM det)
  WHERE us <= (SELECT max(CAST(trunc((frame_idx / 15e0 + 86400) * 1000000) AS BIGINT)) FROM det) // 1000 * 1000 - 2000000""", "det"))
def q_late_rows(spark, sf_dir):
    """Detections played twice through a stream that restarts; what the second run drops as late."""
    from lanternflow.streaming.late import replay_late

    return replay_late(T.detector_rows(spark, sf_dir), ["clip_id", "det_ord"])
