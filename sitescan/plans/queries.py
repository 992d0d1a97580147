"""Registered queries of the site operators over the driver's tables, each with its DuckDB twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitescan.functions import boxes as bx
from sitescan.functions import geometry as geo
from sitescan.functions.boxes import Box
from sitescan.functions.text import keyword_check
from sitescan.operators import assets as A
from sitescan.operators import cloud, dataset, lift, link, matching, metrics, nms, planes, tiles, truth
from sitescan.sources import ingest, io, shared
from sitescan.streaming import stream

from .views import cte, spark_view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of the tables; it is called with a getter for views and tables."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            def get(name: str) -> DataFrame:
                return spark_view(spark, sf_dir, name) if name.startswith("v_") else spark.read.parquet(f"{sf_dir}/{name}.parquet")

            return f(get)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _inter(a: str, b: str) -> str:
    return f"greatest(0, least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1))*greatest(0, least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1))"


def _area(a: str) -> str:
    return f"(greatest(0,{a}.x2-{a}.x1)*greatest(0,{a}.y2-{a}.y1))"


def _iou(a: str, b: str) -> str:
    return f"({_inter(a, b)})/({_area(a)}+{_area(b)}-{_inter(a, b)}+1e-9)"


_LISTS = "lists AS (SELECT site_id, photo, list([struct_pack(det_id := det_id, x1 := x1, y1 := y1, x2 := x2, y2 := y2, conf := conf, cls := cls)] ORDER BY conf DESC, det_id) AS l FROM v_det GROUP BY ALL)"
_NMS = f"nms AS (SELECT site_id, photo, list_reduce(l, lambda acc, b: CASE WHEN len(list_filter(acc, lambda k: {_inter('b[1]', 'k')} > 0.5*({_area('b[1]')}+{_area('k')}-{_inter('b[1]', 'k')}))) > 0 THEN acc ELSE list_concat(acc, b) END) AS l FROM lists)"
_CONTAINED = f"clean AS (SELECT site_id, photo, list_reduce(list_transform(l, lambda x: [x]), lambda acc, b: CASE WHEN len(list_filter(acc, lambda k: ({_inter('b[1]', 'k')})/({_area('b[1]')}+1e-9) > 0.7)) > 0 THEN acc ELSE list_concat(acc, b) END) AS l FROM nms)"
_CLEAN = f"{cte('v_det', 'v_truth', 'v_photos')}, {_LISTS}, {_NMS}, {_CONTAINED}, d AS (SELECT site_id, photo, unnest(l, recursive := true) FROM clean)"
_LOOSE = f"""{_CLEAN}, pairs AS (SELECT d.*, t.truth_id, t.object_id, {_iou('d', 't')} AS iou FROM d JOIN v_truth t ON d.photo = t.photo),
best AS (SELECT photo, det_id, truth_id, object_id, iou FROM pairs WHERE iou >= 0.3 QUALIFY row_number() OVER (PARTITION BY photo, det_id ORDER BY iou DESC, truth_id) = 1),
m AS (SELECT d.*, b.truth_id, b.object_id, b.iou, b.truth_id IS NULL AS false_alarm FROM d LEFT JOIN best b USING (photo, det_id))"""
_TH = "th AS (SELECT unnest([0.25::DOUBLE, 0.4, 0.5, 0.6, 0.7, 0.8]) AS threshold)"


def _clean(get) -> DataFrame:
    return nms.suppress(get("v_det"))


@query(f"""WITH {_LOOSE}, wide AS (SELECT photo, truth_id, x1-30 AS x1, y1-30 AS y1, x2+10 AS x2, y2+10 AS y2 FROM v_truth), near AS (SELECT DISTINCT d.det_id FROM d JOIN wide t ON d.photo = t.photo WHERE {_iou('d', 't')} > 0.1)
SELECT photo, det_id, truth_id, round(iou, 6) AS iou, truth_id IS NULL AND det_id NOT IN (SELECT det_id FROM near) AS false_alarm FROM m""")
def match_loose_boxes(get):
    """J3 with loose boxes: truth boxes, moved out, stand for loose projections."""
    wide = get("v_truth").withColumns({"x1": F.col("x1") - 30, "y1": F.col("y1") - 30, "x2": F.col("x2") + 10, "y2": F.col("y2") + 10})
    return matching.match_loose(_clean(get), get("v_truth"), wide).select("photo", "det_id", "truth_id", F.round("iou", 6).alias("iou"), "false_alarm")


def _matched(get) -> DataFrame:
    return matching.match_loose(_clean(get), get("v_truth"))


@query(
    f"""WITH {_LOOSE}, {_TH}, hit AS (SELECT truth_id, max(conf) AS conf FROM m WHERE truth_id IS NOT NULL GROUP BY 1)
SELECT threshold, (SELECT count(*) FROM hit WHERE conf >= threshold) AS found,
 (SELECT count(*) FROM hit JOIN v_truth USING (truth_id) WHERE conf >= threshold AND difficulty = 'clear') AS clear_found,
 (SELECT count(*) FROM m WHERE false_alarm AND conf >= threshold) AS false_alarms,
 (SELECT count(*) FROM v_truth) AS total, (SELECT count(*) FROM v_truth WHERE difficulty = 'clear') AS clear_total FROM th"""
)
def detector_quality(get):
    """The flagship: boxes cleaned, matched to truth and counted per confidence."""
    return metrics.confidence_sweep(_matched(get), get("v_truth"))


@query(f"WITH {cte('v_det')}, {_LISTS}, {_NMS}, d AS (SELECT site_id, photo, unnest(l, recursive := true) FROM nms) SELECT site_id, photo, det_id, conf FROM d")
def nms_overlap(get):
    return nms.nms(get("v_det")).select("site_id", "photo", "det_id", "conf")


@query(f"WITH {_CLEAN} SELECT site_id, photo, det_id, conf, cls FROM d")
def nms_and_containment(get):
    return _clean(get).select("site_id", "photo", "det_id", "conf", "cls")


@query(f"WITH {cte('v_det')} SELECT a.photo, a.det_id, b.det_id AS other, round({_iou('a', 'b')}, 9) AS iou, round(({_inter('a', 'b')})/({_area('a')}+1e-9), 9) AS inside FROM v_det a JOIN v_det b ON a.photo = b.photo AND a.det_id < b.det_id WHERE {_iou('a', 'b')} >= 0.3")
def box_overlaps(get):
    """P4 over pairs of boxes of one photo."""
    d = get("v_det")
    o = d.select("photo", F.col("det_id").alias("other"), *Box.of().named("ox1", "oy1", "ox2", "oy2"))
    rows = d.join(o, "photo").filter("det_id < other").withColumn("iou", bx.box_iou(Box.of(), Box.of("o"))).filter("iou >= 0.3")
    return rows.select("photo", "det_id", "other", F.round("iou", 9).alias("iou"), F.round(bx.box_inside(Box.of(), Box.of("o")), 9).alias("inside"))


@query(f"""WITH {cte('v_det')} SELECT det_id, x1 + (x2-x1)*0.25 AS s1, y2 - (y2-y1)*0.25 AS s2, x1 - 4 AS w1, y2 + 4 AS w2, greatest(x1, 0) AS c1, least(x2, 200) AS c2,
round((greatest(0, least(x2,200)-greatest(x1,0))*greatest(0, least(y2,200)-greatest(y1,0)))/((x2-x1)*(y2-y1)), 9) AS share,
round((x2-x1)*(y2-y1)*conf*CASE WHEN x1 <= 2 OR y1 <= 2 OR x2 >= 198 OR y2 >= 198 THEN CAST(0.2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END, 6) AS quality,
round((x1+x2)/2/200, 9) AS cx, round((y2-y1)/200, 9) AS h FROM v_det WHERE conf >= 0.4""")
def box_columns(get):
    """P5, P6, P13, P15, P17."""
    side = F.lit(200.0)
    d = bx.confidence_filter(get("v_det"), 0.4)
    b = Box.of()
    s, w, c, f = bx.shrink_box(b), bx.widen_box(b), bx.clip_box(b, side, side), bx.to_centre(b, side, side)
    return d.select("det_id", s.x1.alias("s1"), s.y2.alias("s2"), w.x1.alias("w1"), w.y2.alias("w2"), c.x1.alias("c1"), c.x2.alias("c2"), F.round(bx.in_frame_share(b, side, side), 9).alias("share"), F.round(bx.view_quality(b, F.col("conf"), side, side), 6).alias("quality"), F.round(f[0], 9).alias("cx"), F.round(f[3], 9).alias("h"))


@query(f"""WITH {cte('v_photos')}, p AS (SELECT site_id, photo, 500 + photo*97%3600 AS w, 400 + photo*53%3600 AS h FROM v_photos), s AS (SELECT p.*, unnest([1.0::DOUBLE, 0.5, 0.25]) AS scale FROM p),
k AS (SELECT *, CAST(floor(w*scale) AS INT) AS sw, CAST(floor(h*scale) AS INT) AS sh FROM s WHERE scale = 1 OR greatest(w, h)*scale >= 640),
x AS (SELECT *, unnest(list_distinct(list_transform(range(0, greatest(sw-1024,0)+768, 768), lambda a: least(a, greatest(sw-1024,0))))) AS x0 FROM k),
y AS (SELECT *, unnest(list_distinct(list_transform(range(0, greatest(sh-1024,0)+768, 768), lambda a: least(a, greatest(sh-1024,0))))) AS y0 FROM x)
SELECT site_id, photo, scale, CAST(x0 AS INT) AS x0, CAST(y0 AS INT) AS y0, CAST(least(1024, sw-x0) AS INT) AS tile_w, CAST(least(1024, sh-y0) AS INT) AS tile_h FROM y""")
def plan_tiles(get):
    """P10, P11 for photos of many sizes."""
    p = get("v_photos").select("site_id", "photo", F.expr("CAST(500 + photo*97%3600 AS INT) AS width"), F.expr("CAST(400 + photo*53%3600 AS INT) AS height"))
    return tiles.plan_tiles(p, tiles.scales_for()).select("site_id", "photo", "scale", "x0", "y0", "tile_w", "tile_h")


_TILED = "SELECT site_id, photo, 4096 AS width, 4096 AS height, CAST(CASE det_id%3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.25 END AS DOUBLE) AS scale, CAST(CASE WHEN det_id%3 = 2 THEN 0 ELSE (det_id%2)*768 END AS INT) AS x0, CAST(CASE WHEN det_id%3 = 2 THEN 0 ELSE (det_id%4)*256 END AS INT) AS y0, 1024 AS tile_w, 1024 AS tile_h, x1, y1, x2*4 AS x2, y2*4 AS y2, conf, cls FROM"


@query(f"""WITH {cte('v_det')}, t AS ({_TILED} v_det)
SELECT site_id, photo, (x1+x0)/scale AS x1, (y1+y0)/scale AS y1, (x2+x0)/scale AS x2, (y2+y0)/scale AS y2, conf, cls FROM t
WHERE (x1 >= 4 OR x0 = 0) AND (y1 >= 4 OR y0 = 0) AND (x2 <= tile_w-4 OR x0+tile_w >= width*scale-1) AND (y2 <= tile_h-4 OR y0+tile_h >= height*scale-1)""")
def untile_boxes(get):
    """P12."""
    return tiles.untile_boxes(get("v_det").sparkSession.sql(f"{_TILED} {{d}}", d=get("v_det")))


@query(f"WITH {_LOOSE} SELECT site_id, photo, det_id, truth_id, object_id, round(iou, 9) AS iou, false_alarm FROM m")
def match_loose(get):
    return _matched(get).select("site_id", "photo", "det_id", "truth_id", "object_id", F.round("iou", 9).alias("iou"), "false_alarm")


_FREE = "list_filter(t, lambda k: len(list_filter(acc, lambda a: a.truth_id = k.truth_id)) = 0)"
_EXCL = f"""{_CLEAN}, tl AS (SELECT photo, list(struct_pack(truth_id := truth_id, x1 := x1, y1 := y1, x2 := x2, y2 := y2) ORDER BY truth_id) AS t FROM v_truth GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY photo ORDER BY conf DESC, det_id) AS n FROM d)"""
_GREEDY = f"""{_EXCL}, g AS (
 SELECT photo, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS det_id, CAST(NULL AS BIGINT) AS took, []::BIGINT[] AS used FROM tl
 UNION ALL
 SELECT photo, n, det_id, took, CASE WHEN took IS NULL THEN used ELSE list_append(used, took) END FROM (
  SELECT r.photo, r.n, r.det_id, g.used, (
   SELECT CASE WHEN max(o.iou) >= 0.5 THEN max_by(o.truth_id, o.iou*1e6 + o.truth_id*1e-12) END
   FROM (SELECT k.truth_id, {_iou('r', 'k')} AS iou FROM v_truth k WHERE k.photo = r.photo AND NOT list_contains(g.used, k.truth_id)) o) AS took
  FROM g JOIN r ON r.photo = g.photo AND r.n = g.n + 1) q),
e AS (SELECT photo, det_id, took AS truth_id FROM g WHERE n > 0)"""


@query(f"WITH RECURSIVE {_GREEDY} SELECT d.site_id, d.photo, d.det_id, e.truth_id, e.truth_id IS NOT NULL AS correct FROM d JOIN e USING (photo, det_id)")
def match_exclusive(get):
    """J4."""
    return matching.match_exclusive(_clean(get), get("v_truth")).select("site_id", "photo", "det_id", "truth_id", "correct")


@query(f"""WITH RECURSIVE {_GREEDY}, {_TH}, c AS (SELECT threshold, count(*) FILTER (truth_id IS NOT NULL) AS tp, count(*) FILTER (truth_id IS NULL) AS fp FROM th JOIN (SELECT d.conf, e.truth_id FROM d JOIN e USING (photo, det_id)) q ON q.conf >= threshold GROUP BY 1),
f AS (SELECT c.*, (SELECT count(*) FROM v_truth) - tp AS fn FROM c)
SELECT threshold, tp, fp, fn, tp/(tp+fp) AS precision, tp/(tp+fn) AS recall, 2*(tp/(tp+fp))*(tp/(tp+fn))/((tp/(tp+fp))+(tp/(tp+fn))) AS f1, tp/(tp+fp+fn) AS accuracy FROM f""")
def detection_metrics(get):
    """A10."""
    return metrics.detection_metrics(matching.match_exclusive(_clean(get), get("v_truth")), get("v_truth"))


@query("""WITH s AS (SELECT d.n_chars AS s, l.quality = 1 AS p FROM documents d JOIN labels l USING (doc_id)), g AS (SELECT s, count(*) FILTER (p) AS p, count(*) FILTER (NOT p) AS n FROM s GROUP BY 1),
w AS (SELECT *, sum(n) OVER (ORDER BY s) - n AS below FROM g) SELECT sum(p*(below + n/2)) / (sum(p)*sum(n)) AS auc FROM w""")
def roc_auc(get):
    """A11 of labels against the length of documents."""
    s = get("documents").join(get("labels"), "doc_id").select("n_chars", (F.col("quality") == 1).alias("good"))
    return metrics.roc_auc(s, "n_chars", "good")


@query(f"""WITH RECURSIVE {_GREEDY}, q AS (SELECT d.photo, e.truth_id IS NOT NULL AS ok FROM d JOIN e USING (photo, det_id) WHERE d.conf >= 0.5)
SELECT p.site_id, p.photo, (SELECT count(*) FROM v_truth t WHERE t.photo = p.photo) AS truth, (SELECT count(*) FROM q WHERE q.photo = p.photo AND ok) AS found, (SELECT count(*) FROM q WHERE q.photo = p.photo AND NOT ok) AS "false" FROM v_photos p""")
def metrics_per_photo(get):
    """A12."""
    return metrics.metrics_per_photo(get("v_photos"), get("v_truth"), matching.match_exclusive(_clean(get), get("v_truth")))


@query(f"""WITH {_LOOSE}, h AS (SELECT t.*, t.truth_id IN (SELECT truth_id FROM m WHERE conf >= 0.8) AS hit FROM v_truth t)
SELECT object_id, count(*) FILTER (hit) AS found, count(*) AS total, count(*) FILTER (hit AND difficulty = 'clear') AS clear_found, count(*) FILTER (difficulty = 'clear') AS clear_total, count(DISTINCT object_id) FILTER (hit) AS objects_found
FROM (SELECT object_id, difficulty, coalesce(hit, false) AS hit FROM h) GROUP BY GROUPING SETS ((object_id), ())""")
def recall_per_object(get):
    """A14."""
    return metrics.recall_per_object(_matched(get), get("v_truth"))


@query(f"WITH {_LOOSE} SELECT count(*) AS false_alarms, count(DISTINCT photo) AS photos FROM m WHERE false_alarm AND conf >= 0.8")
def false_alarm_summary(get):
    return metrics.false_alarm_summary(_matched(get))


@query(f"WITH {_LOOSE} SELECT site_id, photo, det_id, conf, CAST(x1 AS INT) AS x1, CAST(y1 AS INT) AS y1, CAST(x2 AS INT) AS x2, CAST(y2 AS INT) AS y2 FROM m WHERE false_alarm ORDER BY conf DESC, site_id, photo, det_id LIMIT 15")
def top_false_alarms(get):
    """T1."""
    return metrics.top_false_alarms(_matched(get))


@query(f"WITH {_LOOSE} SELECT site_id, photo FROM v_truth UNION SELECT site_id, photo FROM m WHERE false_alarm")
def photos_of_interest(get):
    """U1."""
    return matching.photos_of_interest(get("v_truth"), _matched(get))


@query(f"WITH {_LOOSE} SELECT truth_id, photo FROM v_truth WHERE truth_id NOT IN (SELECT truth_id FROM m WHERE truth_id IS NOT NULL)")
def missed_appearances(get):
    """J10, U2."""
    return matching.missed(get("v_truth"), _matched(get)).select("truth_id", "photo")


@query(f"WITH {_CLEAN} SELECT site_id, photo, CAST(list(det_id ORDER BY conf DESC, det_id) AS VARCHAR) AS ids FROM d GROUP BY 1, 2")
def sort_detections(get):
    """Ids as text, strongest first."""
    s = nms.sort_detections(_clean(get))
    return s.select("site_id", "photo", F.concat(F.lit("["), F.array_join(F.transform("detections", lambda d: d.det_id.cast("string")), ", "), F.lit("]")).alias("ids"))


# clouds

_ROOM = "x BETWEEN -10 AND 4 AND y BETWEEN -8 AND 4 AND z BETWEEN -0.5 AND 3"
_VOX = """{c}, p AS (SELECT *, CAST(floor((x+10)/0.5) AS BIGINT) AS vx, CAST(floor((y+8)/0.5) AS BIGINT) AS vy, CAST(floor((z+0.5)/0.5) AS BIGINT) AS vz FROM v_points WHERE {room}),
a AS (SELECT sweep, vx AS ox, vy AS oy, vz AS oz, CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, CAST(z AS FLOAT) AS z FROM p QUALIFY row_number() OVER (PARTITION BY sweep, vx, vy, vz ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) = 1),
b AS (SELECT *, floor((CAST(x AS DOUBLE)+10)/0.5) AS vx, floor((CAST(y AS DOUBLE)+8)/0.5) AS vy, floor((CAST(z AS DOUBLE)+0.5)/0.5) AS vz FROM a),
v AS (SELECT CAST(0 AS BIGINT) AS site_id, sweep, x, y, z FROM b QUALIFY row_number() OVER (PARTITION BY vx, vy, vz ORDER BY sweep, ox, oy, oz) = 1)""".format(c=cte("v_points"), room=_ROOM)


def _thin(get) -> DataFrame:
    return cloud.voxel_downsample(get("v_points"), 0.5, order=("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))


@query(f"WITH {_VOX} SELECT * FROM v")
def voxel_downsample(get):
    """P14, A15."""
    return _thin(get)


@query(f"WITH {_VOX} SELECT site_id, sweep, count(*) AS points FROM v GROUP BY 1, 2")
def points_per_sweep(get):
    """A16."""
    return cloud.points_per_sweep(_thin(get))


@query(f"WITH {cte('v_points')} SELECT site_id, count(*) AS points, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM v_points GROUP BY 1")
def cloud_stats(get):
    return cloud.cloud_stats(get("v_points"))


# cameras and lifting

_R = """cam AS (SELECT *, 2/(qw*qw+qx*qx+qy*qy+qz*qz) AS s FROM v_images),
rot AS (SELECT *, 1-s*(qy*qy+qz*qz) AS r00, s*(qx*qy-qz*qw) AS r01, s*(qx*qz+qy*qw) AS r02, s*(qx*qy+qz*qw) AS r10, 1-s*(qx*qx+qz*qz) AS r11, s*(qy*qz-qx*qw) AS r12, s*(qx*qz-qy*qw) AS r20, s*(qy*qz+qx*qw) AS r21, 1-s*(qx*qx+qy*qy) AS r22 FROM cam)"""
_PIX = f"""{cte('v_points', 'v_images', 'v_plates')}, {_R},
pc AS (SELECT r.photo, r.sweep, r.face, p.x, p.y, p.z, r.fx, r.fy, r.cx, r.cy, r00*(p.x-tx)+r10*(p.y-ty)+r20*(p.z-tz) AS a, r01*(p.x-tx)+r11*(p.y-ty)+r21*(p.z-tz) AS b, -(r02*(p.x-tx)+r12*(p.y-ty)+r22*(p.z-tz)) AS depth FROM v_points p JOIN rot r ON p.sweep = r.sweep),
pix AS (SELECT * FROM (SELECT *, cx+fx*a/depth AS u, cy-fy*b/depth AS v FROM pc WHERE depth > 0.05) q WHERE u >= 0 AND u < 1024 AND v >= 0 AND v < 1024)"""


@query(f"WITH {_PIX} SELECT photo, sweep, count(*) AS n, round(avg(depth), 6) AS depth, round(avg(u), 5) AS u, round(avg(v), 5) AS v FROM pix GROUP BY 1, 2")
def project_points(get):
    """P1, P2, P3 per photo."""
    pix = geo.project_points(get("v_points"), get("v_images")).filter(geo.in_frame())
    return pix.groupBy("photo", "sweep").agg(F.count("*").alias("n"), F.round(F.avg("depth"), 6).alias("depth"), F.round(F.avg("u"), 5).alias("u"), F.round(F.avg("v"), 5).alias("v"))


@query(f"WITH {_PIX} SELECT b.photo, b.box_id, count(*) AS n, round(min(depth), 6) AS depth FROM v_plates b JOIN pix p ON b.photo = p.photo AND p.u BETWEEN b.x1 AND b.x2 AND p.v BETWEEN b.y1 AND b.y2 GROUP BY 1, 2")
def points_in_boxes(get):
    """The range join."""
    got = lift.box_counts(get("v_points"), get("v_images"), get("v_plates"))
    return got.select("photo", "box_id", F.col("n_points").alias("n"), F.round("depth", 6).alias("depth"))


_WIDE = f"""{_PIX}, w AS (SELECT b.photo, b.box_id, p.x, p.y, p.z, p.depth, p.u BETWEEN b.x1+(b.x2-b.x1)*0.25 AND b.x2-(b.x2-b.x1)*0.25 AND p.v BETWEEN b.y1+(b.y2-b.y1)*0.25 AND b.y2-(b.y2-b.y1)*0.25 AS inn
 FROM v_plates b JOIN pix p ON b.photo = p.photo AND p.u BETWEEN b.x1-4 AND b.x2+4 AND p.v BETWEEN b.y1-4 AND b.y2+4),
s AS (SELECT photo, box_id, count(*) FILTER (inn) >= 5 AS use, CASE WHEN count(*) FILTER (inn) >= 5 THEN quantile_cont(depth, 0.25) FILTER (inn) ELSE quantile_cont(depth, 0.25) END AS front FROM w GROUP BY 1, 2)"""


@query(f"WITH {_WIDE} SELECT photo, box_id, count(*) AS n_points, round(median(x), 6) AS x, round(median(y), 6) AS y, round(median(z), 6) AS z FROM w JOIN s USING (photo, box_id) WHERE (inn OR NOT use) AND depth <= front + 0.05 GROUP BY 1, 2")
def lift_boxes(get):
    """A1."""
    got = lift.lift_boxes(get("v_points"), get("v_images"), get("v_plates"))
    return got.select("photo", "box_id", "n_points", *(F.round(a, 6).alias(a) for a in "xyz"))


_SPOTS = "SELECT site_id, photo, box_id, (x1+x2)/2 AS u, (y1+y2)/2 AS v FROM"


@query(f"WITH {_PIX}, q AS ({_SPOTS} v_plates), w AS (SELECT q.photo, q.box_id, p.depth FROM q JOIN pix p ON q.photo = p.photo AND p.u BETWEEN q.u-12 AND q.u+12 AND p.v BETWEEN q.v-12 AND q.v+12), g AS (SELECT photo, box_id, quantile_cont(depth, 0.25) AS d FROM w GROUP BY 1, 2) SELECT q.photo, q.box_id, round(g.d, 6) AS depth_at FROM q LEFT JOIN g USING (photo, box_id)")
def depth_at(get):
    """A3."""
    spots = get("v_plates").select("site_id", "photo", "box_id", F.expr("(x1+x2)/2").alias("u"), F.expr("(y1+y2)/2").alias("v"))
    return lift.depth_at(get("v_points"), get("v_images"), spots).select("photo", "box_id", F.round("depth_at", 6).alias("depth_at"))


_SPOT_POINTS = f"{_PIX}, q AS ({_SPOTS} v_plates), w AS (SELECT q.photo, q.box_id, p.x, p.y, p.z, p.depth FROM q JOIN pix p ON q.photo = p.photo AND p.u BETWEEN q.u-12 AND q.u+12 AND p.v BETWEEN q.v-12 AND q.v+12), f AS (SELECT photo, box_id, quantile_cont(depth, 0.25) AS front FROM w GROUP BY 1, 2)"


@query(f"WITH {_SPOT_POINTS}, m AS (SELECT photo, box_id, count(*) AS n_points, round(median(x), 6) AS x, round(median(y), 6) AS y, round(median(z), 6) AS z FROM w JOIN f USING (photo, box_id) WHERE depth <= front + 0.05 GROUP BY 1, 2) SELECT q.photo, q.box_id, n_points, x, y, z FROM q LEFT JOIN m USING (photo, box_id)")
def pixels_to_world(get):
    """A2."""
    spots = get("v_plates").select("site_id", "photo", "box_id", F.expr("(x1+x2)/2").alias("u"), F.expr("(y1+y2)/2").alias("v"))
    got = lift.pixels_to_world(get("v_points"), get("v_images"), spots)
    return got.select("photo", "box_id", "n_points", *(F.round(a, 6).alias(a) for a in "xyz"))


_CROSS = {"a": ("(xx-l)", "xy", "xz", "xy", "(yy-l)", "yz"), "b": ("(xx-l)", "xy", "xz", "xz", "yz", "(zz-l)"), "c": ("xy", "(yy-l)", "yz", "xz", "yz", "(zz-l)")}


def _fitted(source: str, keys: str, to: str) -> str:
    """CTEs from rows (keys, x, y, z) of `source` to `to` (keys, n, px, py, pz, nx, ny, nz), normals of either sign."""
    side = "struct_pack(d := ({0})*({0})+({1})*({1})+({2})*({2}), x := {0}, y := {1}, z := {2})"
    v = ", ".join(side.format(f"({q}*{w}-{r}*{u})", f"({r}*{t}-{p}*{w})", f"({p}*{u}-{q}*{t})") for p, q, r, t, u, w in _CROSS.values())
    det = "(xx-q)*((yy-q)*(zz-q)-yz*yz) - xy*(xy*(zz-q)-yz*xz) + xz*(xy*yz-(yy-q)*xz)"
    return f"""{to}1 AS (SELECT {keys}, count(*) AS n, avg(x) AS px, avg(y) AS py, avg(z) AS pz, covar_pop(x, x) AS xx, covar_pop(y, y) AS yy, covar_pop(z, z) AS zz, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz FROM {source} GROUP BY {keys}),
{to}2 AS (SELECT *, (xx+yy+zz)/3 AS q FROM {to}1), {to}3 AS (SELECT *, ((xx-q)*(xx-q)+(yy-q)*(yy-q)+(zz-q)*(zz-q)+2*(xy*xy+xz*xz+yz*yz))/6 AS p FROM {to}2),
{to}4 AS (SELECT *, q + 2*sqrt(p)*cos(acos(greatest(-1, least(1, ({det})/(2*p*sqrt(p)))))/3 + 2*pi()/3) AS l FROM {to}3 WHERE p > 0),
{to}5 AS (SELECT *, list_max([{v}]) AS v FROM {to}4), {to} AS (SELECT {keys}, n, px, py, pz, v.x/sqrt(v.d) AS nx, v.y/sqrt(v.d) AS ny, v.z/sqrt(v.d) AS nz FROM {to}5 WHERE v.d > 1e-12*p*p)"""


_HELD = "SELECT b.photo, b.box_id, p.x, p.y, p.z, p.depth FROM v_plates b JOIN pix p ON b.photo = p.photo"


@query(f"""WITH {_PIX}, w AS ({_HELD} AND p.u BETWEEN b.x1 AND b.x2 AND p.v BETWEEN b.y1 AND b.y2), g AS (SELECT photo, box_id, quantile_cont(depth, 0.6) AS front FROM w GROUP BY 1, 2 HAVING count(*) >= 8),
near AS (SELECT w.photo, w.box_id, w.x, w.y, w.z FROM w JOIN g USING (photo, box_id) WHERE depth <= front), {_fitted("near", "photo, box_id", "pl")},
f AS (SELECT pl.*, CASE WHEN (tx-px)*nx + (ty-py)*ny + (tz-pz)*nz < 0 THEN -1 ELSE 1 END AS s FROM pl JOIN v_images USING (photo))
SELECT b.photo, b.box_id, round(s*nx, 5) AS nx, round(s*ny, 5) AS ny, round(s*nz, 5) AS nz FROM v_plates b LEFT JOIN f USING (photo, box_id)""")
def plane_normals(get):
    """A5, A6."""
    got = planes.surface_normals(get("v_points"), get("v_images"), get("v_plates"), least=8)
    return got.select("photo", "box_id", *(F.round("n" + a, 5).alias("n" + a) for a in "xyz"))


@query(f"WITH {cte('v_points')} SELECT sweep, count(*) AS n, round(avg(x), 6) AS px, round(avg(y), 6) AS py, round(avg(z), 6) AS pz, CAST(1 AS DOUBLE) AS length, true AS least FROM v_points GROUP BY 1")
def fit_planes(get):
    """A5: a normal has length 1, and moving along it varies no more than along any axis."""
    p = get("v_points").select("sweep", "x", "y", "z")
    fit = planes.fit_planes(p, ["sweep"])
    along = sum((F.col("n" + a) * F.col(a) for a in "yz"), F.col("nx") * F.col("x"))
    spread = p.join(fit.select("sweep", "nx", "ny", "nz"), "sweep").groupBy("sweep").agg(F.var_pop(along).alias("along"), *(F.var_pop(a).alias("v" + a) for a in "xyz"))
    got = fit.join(spread, "sweep")
    length = F.round(F.sqrt(sum((F.col("n" + a) * F.col("n" + a) for a in "yz"), F.col("nx") * F.col("nx"))), 6)
    return got.select("sweep", "n", *(F.round("p" + a, 6).alias("p" + a) for a in "xyz"), length.alias("length"), (F.col("along") <= F.least("vx", "vy", "vz") + 1e-9).alias("least"))


def _objects(get) -> DataFrame:
    """Plates of 0.4 m around the assets' places, facing +x."""
    a = get("v_assets")
    corner = lambda dy, dz: F.struct(F.col("x"), (F.col("y") + dy).alias("y"), (F.col("z") + dz).alias("z"))
    return a.select(
        F.lit(0).cast("long").alias("site_id"), F.col("asset_id").alias("object_id"), F.col("product").alias("model"), F.lit("room").alias("location"),
        F.array(corner(-0.2, 0.2), corner(0.2, 0.2), corner(0.2, -0.2), corner(-0.2, -0.2)).alias("corners"),
        F.struct("x", "y", "z").alias("center"), F.struct(F.lit(1.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")).alias("normal"),
    )


def _appearances(get) -> DataFrame:
    """Whatever stands before it."""
    return truth.for_shapes(_objects(get), lambda shapes: truth.appearances(truth.visibility_filter(truth.project_objects(shapes, get("v_images")))))


_STRICT = f"""{cte('v_assets')}, {_PIX}, k AS (SELECT unnest([struct_pack(dy := -0.2::DOUBLE, dz := 0.2::DOUBLE, c := true), struct_pack(dy := 0.2::DOUBLE, dz := 0.2::DOUBLE, c := true), struct_pack(dy := 0.2::DOUBLE, dz := -0.2::DOUBLE, c := true), struct_pack(dy := -0.2::DOUBLE, dz := -0.2::DOUBLE, c := true), struct_pack(dy := 0::DOUBLE, dz := 0::DOUBLE, c := false)]) AS d),
oq AS (SELECT r.photo, o.asset_id AS object_id, o.product AS model, d.c AS corner, o.x-tx AS a, o.y+d.dy-ty AS b, o.z+d.dz-tz AS c, r.* EXCLUDE (photo) FROM v_assets o CROSS JOIN k CROSS JOIN rot r),
oe AS (SELECT photo, object_id, model, corner, -(r02*a+r12*b+r22*c) AS depth, cx+fx*(r00*a+r10*b+r20*c)/-(r02*a+r12*b+r22*c) AS u, cy-fy*(r01*a+r11*b+r21*c)/-(r02*a+r12*b+r22*c) AS v, sqrt(a*a+b*b+c*c) AS dist, -a/sqrt(a*a+b*b+c*c) AS cosine FROM oq),
ob AS (SELECT photo, object_id, model, min(u) FILTER (corner) AS x1, min(v) FILTER (corner) AS y1, max(u) FILTER (corner) AS x2, max(v) FILTER (corner) AS y2, max(depth) FILTER (NOT corner) AS depth, max(dist) FILTER (NOT corner) AS dist, max(cosine) FILTER (NOT corner) AS cosine FROM oe GROUP BY ALL HAVING min(depth) > 0.05),
oc AS (SELECT *, greatest(x1, 0) AS a1, greatest(y1, 0) AS b1, least(x2, 1024) AS a2, least(y2, 1024) AS b2, degrees(acos(greatest(-1, least(1, cosine)))) AS angle FROM ob),
os AS (SELECT *, greatest(0, a2-a1)*greatest(0, b2-b1)/((x2-x1)*(y2-y1)) AS share FROM oc WHERE greatest(0, a2-a1)*greatest(0, b2-b1) > 0),
seen AS (SELECT photo, object_id, model, a1, b1, a2, b2, depth, dist, angle, share, list_filter([CASE WHEN share < 0.95 THEN 'cut by photo edge' END, CASE WHEN angle > 65 THEN 'steep angle' END, CASE WHEN a2-a1 < 60 THEN 'small' END], lambda t: t IS NOT NULL) AS why FROM os WHERE angle < 85 AND share >= 0.2),
shown AS (SELECT *, CASE WHEN len(why) = 0 THEN 'clear' ELSE 'hard: ' || array_to_string(why, ', ') END AS difficulty FROM seen)"""


@query(f"""WITH {_STRICT}, hidden AS (SELECT s.photo, s.object_id FROM shown s JOIN pix p ON s.photo = p.photo AND abs(p.u-(a1+a2)/2) <= greatest(6, (a2-a1)/4) AND abs(p.v-(b1+b2)/2) <= greatest(6, (a2-a1)/4) GROUP BY s.photo, s.object_id, s.depth HAVING quantile_cont(p.depth, 0.25) < s.depth - 0.25)
SELECT photo, object_id, model, CAST(round_even(a1, 0) AS INT) AS x1, CAST(round_even(b1, 0) AS INT) AS y1, CAST(round_even(a2, 0) AS INT) AS x2, CAST(round_even(b2, 0) AS INT) AS y2, CAST(round_even(angle, 0) AS INT) AS view_angle_deg, round(dist, 6) AS distance_m, difficulty FROM shown ANTI JOIN hidden USING (photo, object_id)""")
def object_appearances(get):
    """J2 strict, P6 to P9, A4, A18's flat table."""

    def seen(shapes: DataFrame) -> DataFrame:
        boxes = truth.visibility_filter(truth.project_objects(shapes, get("v_images")))
        boxes = truth.occlusion_filter(boxes, get("v_points"), get("v_images"))
        return truth.appearances(boxes.withColumn("exact", F.round("distance_m", 6)), "exact")

    got = truth.for_shapes(_objects(get), seen)
    return got.select("photo", "object_id", "model", "x1", "y1", "x2", "y2", "view_angle_deg", "difficulty", F.col("exact").alias("distance_m"))


@query(f"""WITH {cte('v_assets', 'v_images')}, {_R}, k AS (SELECT unnest([struct_pack(dy := -0.2::DOUBLE, dz := 0.2::DOUBLE), struct_pack(dy := 0.2::DOUBLE, dz := 0.2::DOUBLE), struct_pack(dy := 0.2::DOUBLE, dz := -0.2::DOUBLE), struct_pack(dy := -0.2::DOUBLE, dz := -0.2::DOUBLE)]) AS d),
q AS (SELECT r.photo, o.asset_id AS object_id, o.x-tx AS a, o.y+d.dy-ty AS b, o.z+d.dz-tz AS c, r.* EXCLUDE (photo) FROM v_assets o CROSS JOIN k CROSS JOIN rot r),
e AS (SELECT photo, object_id, -(r02*a+r12*b+r22*c) AS depth, r00*a+r10*b+r20*c AS ex, r01*a+r11*b+r21*c AS ey, fx, fy, cx, cy FROM q)
SELECT photo, object_id, round(min(cx+fx*ex/depth), 4) AS x1, round(min(cy-fy*ey/depth), 4) AS y1, round(max(cx+fx*ex/depth), 4) AS x2, round(max(cy-fy*ey/depth), 4) AS y2 FROM e GROUP BY 1, 2 HAVING min(depth) > 0.05""")
def loose_projections(get):
    """J2 loose."""

    def seen(shapes: DataFrame) -> DataFrame:
        p = truth.project_objects(shapes, get("v_images"), strict=False)
        return p.select("site_id", "photo", "object_id", *(F.round(c, 4).alias(c) for c in ("x1", "y1", "x2", "y2")))

    return truth.for_shapes(_objects(get), seen).drop("site_id")


@query(f"WITH {_STRICT} SELECT object_id, count(DISTINCT photo) AS photos, count(DISTINCT CASE WHEN difficulty = 'clear' THEN photo END) AS clear_photos, count(*) AS appearances FROM shown GROUP BY ROLLUP (object_id)")
def truth_summary(get):
    """A18."""
    return truth.truth_summary(_appearances(get))


def _ray(u: str, v: str, i: int) -> str:
    """Coordinates t{i}x, t{i}y, t{i}z where a pixel's ray meets the plane of the row."""
    way = [f"(r{k}0*(({u})-cx)/fx - r{k}1*(({v})-cy)/fy - r{k}2)" for k in range(3)]
    step = f"(((px-tx)*nx+(py-ty)*ny+(pz-tz)*nz)/({way[0]}*nx+{way[1]}*ny+{way[2]}*nz))"
    return ", ".join(f"t{a}+{w}*{step} AS t{i}{a}" for a, w in zip("xyz", way, strict=True))


_PLATE = "p.u BETWEEN b.x1+(b.x2-b.x1)*0.15 AND b.x2-(b.x2-b.x1)*0.15 AND p.v BETWEEN b.y1+(b.y2-b.y1)*0.15 AND b.y2-(b.y2-b.y1)*0.15"
_SIDE = "sqrt((t{0}x-t{1}x)*(t{0}x-t{1}x)+(t{0}y-t{1}y)*(t{0}y-t{1}y)+(t{0}z-t{1}z)*(t{0}z-t{1}z))"


@query(f"""WITH {_PIX}, w AS ({_HELD} AND {_PLATE}), {_fitted("w", "photo, box_id", "first")},
near AS (SELECT w.photo, w.box_id, w.x, w.y, w.z FROM w JOIN first USING (photo, box_id) WHERE abs((x-px)*nx+(y-py)*ny+(z-pz)*nz) <= 1.5), {_fitted("near", "photo, box_id", "pl")},
k AS (SELECT b.box_id AS object_id, {_ray("b.x1", "b.y1", 0)}, {_ray("b.x2", "b.y1", 1)}, {_ray("b.x2", "b.y2", 2)}, {_ray("b.x1", "b.y2", 3)}, tx, ty, tz FROM pl JOIN v_plates b USING (photo, box_id) JOIN rot r USING (photo)),
o AS (SELECT *, {_SIDE.format(1, 0)} AS width_m, {_SIDE.format(3, 0)} AS height_m, (t0x+t2x)/2 AS x, (t0y+t2y)/2 AS y, (t0z+t2z)/2 AS z,
 (t1y-t0y)*(t3z-t0z)-(t1z-t0z)*(t3y-t0y) AS mx, (t1z-t0z)*(t3x-t0x)-(t1x-t0x)*(t3z-t0z) AS my, (t1x-t0x)*(t3y-t0y)-(t1y-t0y)*(t3x-t0x) AS mz FROM k)
SELECT object_id, round(width_m, 4) AS width_m, round(height_m, 4) AS height_m, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z,
 {", ".join(f"round(CASE WHEN mx*(tx-x)+my*(ty-y)+mz*(tz-z) < 0 THEN -m{a} ELSE m{a} END / sqrt(mx*mx+my*my+mz*mz), 4) AS n{a}" for a in "xyz")} FROM o WHERE width_m < 5 AND height_m < 5""")
def marked_objects(get):
    """Objects from boxes of plates as marks; the invented points are thin, so a plane goes through those within 1.5 m of the first."""
    marks = get("v_plates").withColumn("object_id", F.col("box_id")).withColumns({"kind": F.lit("full"), "model": F.lit("m"), "location": F.lit("room")}).drop("box_id")
    got = truth.build_objects(get("v_points"), get("v_images"), marks, near=1.5).filter("width_m < 5 and height_m < 5")
    return got.select("object_id", *(F.round(c, 4).alias(n) for c, n in (("width_m", "width_m"), ("height_m", "height_m"), ("center.x", "x"), ("center.y", "y"), ("center.z", "z"), ("normal.x", "nx"), ("normal.y", "ny"), ("normal.z", "nz"))))


@query(f"""WITH {cte('v_images')} SELECT sweep, CAST(list([CAST(face AS BIGINT), CAST(qw AS BIGINT), CAST(qx AS BIGINT)] ORDER BY face) AS VARCHAR) AS faces, min_by(tx, face) AS tx FROM v_images GROUP BY 1""")
def scene_sweeps(get):
    """Orientations as whole numbers, w back in front."""
    s = cloud.scene_sweeps(get("v_images"))
    whole = F.transform("faces", lambda f: F.concat(F.lit("["), F.array_join(F.array((f.file % 10).cast("string"), f.quaternion_xyzw[3].cast("long").cast("string"), f.quaternion_xyzw[0].cast("long").cast("string")), ", "), F.lit("]")))
    return s.select("sweep", F.concat(F.lit("["), F.array_join(whole, ", "), F.lit("]")).alias("faces"), F.col("position")[0].alias("tx"))


# assets and links

_NEAR = """n AS (SELECT a.site_id, a.{l}, r.{r}, sqrt((a.x-r.x)*(a.x-r.x)+(a.y-r.y)*(a.y-r.y)+(a.z-r.z)*(a.z-r.z)) AS distance FROM {a} a JOIN {b} r ON a.site_id = r.site_id),
b AS (SELECT * FROM n WHERE distance {op} QUALIFY row_number() OVER (PARTITION BY site_id, {l} ORDER BY distance, {r}) = 1)"""


@query(f"WITH {cte('v_assets', 'v_register')}, {_NEAR.format(l='asset_id', r='entry_id', a='v_assets', b='v_register', op='<= 0.5')}, w AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY site_id, entry_id ORDER BY asset_id) = 1) SELECT a.site_id, a.asset_id, w.entry_id, round(w.distance, 6) AS distance, w.entry_id IS NOT NULL AS registered, coalesce(g.tag_name, 'Unregistered ' || a.product) AS title FROM v_assets a LEFT JOIN w USING (site_id, asset_id) LEFT JOIN v_register g ON g.site_id = a.site_id AND g.entry_id = w.entry_id")
def link_register(get):
    """J6."""
    got = link.link_register(get("v_assets"), get("v_register"), 0.5)
    return got.select("site_id", "asset_id", "entry_id", F.round("distance", 6).alias("distance"), "registered", "title")


@query(f"WITH {cte('v_assets', 'v_register')}, {_NEAR.format(l='asset_id', r='entry_id', a='v_assets', b='v_register', op='<= 0.5')} SELECT site_id, entry_id FROM v_register WHERE entry_id NOT IN (SELECT entry_id FROM b)")
def entries_not_found(get):
    """J10, U2."""
    linked = link.link_register(get("v_assets"), get("v_register"), 0.5)
    return link.entries_not_found(get("v_register"), linked).select("site_id", "entry_id")


@query(f"WITH {cte('v_assets', 'v_register')}, {_NEAR.format(l='asset_id', r='entry_id', a='v_assets', b='v_register', op='< 0.4')} SELECT a.site_id, a.asset_id, b.entry_id AS object_id, round(b.distance*100, 4) AS error_cm, CASE WHEN b.entry_id IS NULL THEN 'NOT A RELAY' ELSE 'match' END AS verdict FROM v_assets a LEFT JOIN b USING (site_id, asset_id)")
def compare_to_truth(get):
    """J7."""
    got = link.compare_to_truth(get("v_assets"), get("v_register").withColumnRenamed("entry_id", "object_id"), 0.4)
    return got.select("site_id", "asset_id", "object_id", F.round("error_cm", 4).alias("error_cm"), "verdict")


def _products(get) -> DataFrame:
    """Products of `part`, by name, with the suppliers of the same number as documents."""
    p = get("part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_brand").alias("manufacturer"), F.min("p_type").alias("description"), F.min("p_partkey").alias("product_id"))
    d = get("supplier").select(F.col("s_suppkey").alias("product_id"), F.struct(F.col("s_name").alias("title"), F.concat(F.lit("doc-"), (F.col("s_suppkey") % 40).cast("string")).alias("doc_id")).alias("d"))
    d = d.groupBy("product_id").agg(F.array_sort(F.collect_list("d")).alias("documents"))
    return p.join(d, "product_id", "left").withColumn("documents", F.coalesce("documents", F.array().cast("array<struct<title:string,doc_id:string>>")))


_PROD = "prod AS (SELECT p_name AS name, min(p_brand) AS manufacturer, min(p_type) AS description, min(p_partkey) AS product_id FROM part GROUP BY 1)"


@query(f"WITH {_PROD} SELECT l.l_orderkey, l.l_linenumber, p.p_name AS product, g.manufacturer, g.description, coalesce(s.s_name || ' doc-' || (s.s_suppkey % 40), '') AS documents FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN prod g ON g.name = p.p_name LEFT JOIN supplier s ON s.s_suppkey = g.product_id")
def link_products(get):
    """J5."""
    rows = get("lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey")).join(get("part").select("p_partkey", F.col("p_name").alias("product")), "p_partkey")
    got = link.link_products(rows, _products(get))
    return got.select("l_orderkey", "l_linenumber", "product", "manufacturer", "description", F.array_join(F.transform("documents", lambda d: F.concat_ws(" ", d.title, d.doc_id)), ",").alias("documents"))


@query(f"WITH {_PROD}, d AS (SELECT 'doc-' || (s_suppkey % 40) AS doc_id, s_suppkey AS product_id, s_name AS title FROM supplier JOIN prod ON product_id = s_suppkey) SELECT doc_id, product_id, title FROM d QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY product_id) = 1")
def find_document(get):
    """J11."""
    ids = get("supplier").select(F.concat(F.lit("doc-"), (F.col("s_suppkey") % 40).cast("string")).alias("doc_id"))
    return link.find_document(_products(get), ids).select("doc_id", "product_id", "title")


_KEYS = ["site_id", "cls", "cluster"]
_KEEP = f"""{cte('v_clustered')}, c AS (SELECT site_id, cls, cluster, sum(conf*x)/sum(conf) AS px, sum(conf*y)/sum(conf) AS py, sum(conf*z)/sum(conf) AS pz, count(*) AS sightings, count(DISTINCT sweep) AS sweeps, avg(conf) AS mc, max(conf) AS xc FROM v_clustered GROUP BY 1, 2, 3)"""


@query(f"""WITH {_KEEP} SELECT c.site_id, c.cls, c.cluster, round(px, 6) AS x, round(py, 6) AS y, round(pz, 6) AS z, CAST(list(v.photo ORDER BY join_no) AS VARCHAR) AS photos, CAST(list(CAST(v.y2 AS INT) ORDER BY join_no) AS VARCHAR) AS bottoms, sightings, sweeps, round(xc, 3) AS max_confidence, round(max(sqrt((v.x-px)*(v.x-px)+(v.y-py)*(v.y-py)+(v.z-pz)*(v.z-pz))), 6) AS spread_m FROM c JOIN v_clustered v ON c.site_id = v.site_id AND c.cls = v.cls AND c.cluster = v.cluster WHERE sweeps >= 5 GROUP BY ALL""")
def assets_from_clusters(get):
    """A8."""
    got = A.assets_from_clusters(get("v_clustered"), _KEYS)
    return got.select(*_KEYS, *(F.round(a, 6).alias(a) for a in "xyz"), *(F.col("seen_in." + c).cast("string").alias(n) for c, n in (("photo", "photos"), ("y2", "bottoms"))), "sightings", F.size("sweeps").cast("long").alias("sweeps"), "max_confidence", F.round("spread_m", 6).alias("spread_m"))


@query(f"WITH {_KEEP} SELECT site_id, count(*) FILTER (sweeps >= 5) AS kept, count(*) FILTER (sweeps < 5) AS rejected, CAST(coalesce(sum(sightings) FILTER (sweeps < 5), 0) AS BIGINT) AS rejected_sightings, CAST(coalesce(list(sweeps ORDER BY sweeps) FILTER (sweeps < 5), []) AS VARCHAR) AS rejected_sweeps FROM c GROUP BY 1")
def cluster_summary(get):
    """A9."""
    return A.cluster_summary(get("v_clustered"), _KEYS).select("site_id", "kept", "rejected", "rejected_sightings", F.col("rejected_sweeps").cast("string").alias("rejected_sweeps"))


@query(f"WITH {cte('v_clustered')} SELECT site_id, cls, cluster, photo AS best_photo, CAST(x1 AS INT) AS bx, conf AS best_conf FROM v_clustered QUALIFY row_number() OVER (PARTITION BY site_id, cls, cluster ORDER BY (x2-x1)*(y2-y1)*conf*CASE WHEN x1 <= 2 OR y1 <= 2 OR x2 >= 1022 OR y2 >= 1022 THEN CAST(0.2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END DESC, join_no) = 1")
def best_view(get):
    """W5, P15."""
    got = A.best_view(get("v_clustered"), _KEYS, F.lit(1024.0), F.lit(1024.0), F.col("join_no"))
    return got.select(*_KEYS, "best_photo", F.col("best_box")[0].alias("bx"), "best_conf")


@query(f"WITH {cte('v_assets')} SELECT site_id, asset_id AS k, format('asset-{{:02d}}', row_number() OVER (PARTITION BY site_id ORDER BY product, round_even(x, 1), round_even(y, 1), round_even(z, 1), asset_id)) AS asset_id FROM v_assets")
def number_assets(get):
    """W4."""
    a = get("v_assets").select("site_id", F.col("asset_id").alias("k"), F.col("product").alias("cls"), "x", "y", "z")
    return A.number_assets(a, ("k",)).select("site_id", "k", "asset_id")


_FAR = "sqrt((c.cx-b[1].cx)*(c.cx-b[1].cx)+(c.cy-b[1].cy)*(c.cy-b[1].cy)+(c.cz-b[1].cz)*(c.cz-b[1].cz))"
_FOLD = f"""{cte('v_clustered')}, o AS (SELECT site_id, cls, list([struct_pack(k := CAST(0 AS BIGINT), cx := x, cy := y, cz := z, xs := [x], ys := [y], zs := [z], ids := [struct_pack(photo := photo, det_id := det_id)])] ORDER BY conf DESC, photo, det_id) AS l FROM v_clustered GROUP BY 1, 2),
f AS (SELECT site_id, cls, list_reduce(l, lambda acc, b: list_transform([list_min(list_transform(list_filter(acc, lambda c: {_FAR} <= 0.15), lambda c: struct_pack(d := {_FAR}, k := c.k))).k], lambda m:
 CASE WHEN m IS NULL THEN list_append(acc, struct_pack(k := CAST(len(acc) AS BIGINT), cx := b[1].cx, cy := b[1].cy, cz := b[1].cz, xs := b[1].xs, ys := b[1].ys, zs := b[1].zs, ids := b[1].ids))
 ELSE list_transform(acc, lambda c: CASE WHEN c.k = m THEN struct_pack(k := c.k, cx := list_median(list_concat(c.xs, b[1].xs)), cy := list_median(list_concat(c.ys, b[1].ys)), cz := list_median(list_concat(c.zs, b[1].zs)),
  xs := list_concat(c.xs, b[1].xs), ys := list_concat(c.ys, b[1].ys), zs := list_concat(c.zs, b[1].zs), ids := list_concat(c.ids, b[1].ids)) ELSE c END) END)[1]) AS c FROM o),
g AS (SELECT site_id, cls, unnest(c) AS c FROM f)"""


@query(f"WITH {_FOLD} SELECT site_id, cls, c.ids[i].photo AS photo, c.ids[i].det_id AS det_id, c.k AS cluster, i - 1 AS join_no FROM (SELECT *, unnest(range(1, len(c.ids) + 1)) AS i FROM g)")
def cluster_sightings(get):
    """W3."""
    s = get("v_clustered").select("site_id", "cls", "sweep", "photo", "det_id", "conf", "x", "y", "z")
    return A.cluster_sightings(s, 0.15).select("site_id", "cls", "photo", "det_id", "cluster", "join_no")


@query(f"WITH {_FOLD} SELECT site_id, cls, c.k AS cluster, len(c.ids) AS members, round(c.cx, 6) AS x, round(c.cy, 6) AS y, round(c.cz, 6) AS z FROM g")
def cluster_centres(get):
    """W3 in tiles of 0.9 m: a class of a site is folded in many pieces, and settled between them."""
    s = get("v_clustered").select("site_id", "cls", "photo", "det_id", "conf", "x", "y", "z")
    got = A.cluster_sightings(s, 0.15, whole=500, tile=6)
    return got.groupBy("site_id", "cls", "cluster").agg(F.count("*").alias("members"), *(F.round(F.median(a), 6).alias(a) for a in "xyz"))


# training sets

_FILES = "SELECT CAST(doc_id AS VARCHAR) AS name, md5(coalesce(text, '')) AS md5 FROM documents"


def _files(get) -> DataFrame:
    return get("documents").select(F.col("doc_id").cast("string").alias("name"), F.md5(F.coalesce("text", F.lit(""))).alias("md5"))


@query(f"WITH f AS ({_FILES}) SELECT name, md5, name <> min(name) OVER (PARTITION BY md5) AS duplicate FROM f")
def dedup_photos(get):
    """W6."""
    return dataset.dedup_photos(_files(get)).select("name", "md5", "duplicate")


@query("""WITH h AS (SELECT CAST(doc_id AS VARCHAR) AS name, md5('0|' || CAST(doc_id AS VARCHAR)) AS h FROM documents), r AS (SELECT *, row_number() OVER (ORDER BY h, name) AS n, count(*) OVER () AS c FROM h) SELECT name, CASE WHEN n <= round_even(c*0.15, 0) THEN 'val' ELSE 'train' END AS split FROM r""")
def assign_split(get):
    """W7."""
    return dataset.assign_split(_files(get).select("name"))


@query("""WITH h AS (SELECT CAST(doc_id AS VARCHAR) AS name, md5('0|' || CAST(doc_id AS VARCHAR)) AS h FROM documents), r AS (SELECT *, row_number() OVER (ORDER BY h, name) AS n, count(*) OVER () AS c FROM h),
t AS (SELECT name, row_number() OVER (ORDER BY substr(md5(name), 1, 3), name) - 1 AS i, count(*) OVER () AS t, CAST(round_even(c*2.0, 0) AS BIGINT) AS items FROM r WHERE n > round_even(c*0.15, 0)) SELECT unnest(range(i, items, t)) AS k, name FROM t""")
def assign_sources(get):
    """W8."""
    return dataset.assign_sources(dataset.assign_split(_files(get).select("name")))


@query("""WITH f AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS name, md5(coalesce(text, '')) AS m, coalesce(text, '') <> '' AS readable FROM documents), d AS (SELECT *, name <> min(name) OVER (PARTITION BY m) AS duplicate FROM f)
SELECT name, CASE WHEN duplicate OR NOT readable THEN 'skipped' WHEN doc_id%4 = 0 OR doc_id%5 = 0 AND doc_id%3 <> 0 THEN 'used' ELSE 'skipped' END AS status,
CASE WHEN duplicate THEN 'duplicate' WHEN NOT readable THEN 'unreadable' WHEN doc_id%4 = 0 THEN 'scan labels' WHEN doc_id%5 = 0 AND doc_id%3 <> 0 THEN 'web labels' WHEN doc_id%5 = 0 THEN 'left out on purpose' ELSE 'no labels' END AS reason FROM d""")
def label_photos(get):
    """Labels by the documents' numbers."""
    f = dataset.dedup_photos(_files(get).join(get("documents").select(F.col("doc_id").cast("string").alias("name"), (F.coalesce("text", F.lit("")) != "").alias("readable")), "name"))
    one = F.array(F.struct(*(F.lit(v).alias(n) for n, v in (("x1", 0.0), ("y1", 0.0), ("x2", 9.0), ("y2", 9.0)))))
    ids = get("documents").select("doc_id", F.col("doc_id").cast("string").alias("name"))
    scan = ids.filter("doc_id % 4 = 0").select("name", one.alias("boxes"))
    web = ids.filter("doc_id % 5 = 0").select("name", F.when(F.col("doc_id") % 3 != 0, one).alias("boxes"))
    return dataset.label_photos(f, scan, web).select("name", "status", "reason")


def _drawn(i: int) -> str:
    return f"CAST(CAST('0x' || substr(md5('0|' || site_id || '|' || k || '|{i}'), 1, 12) AS BIGINT) AS DOUBLE)/281474976710656"


def _middle(lo: str, hi: str, i: int) -> str:
    first, last = f"greatest({hi} - side/2, side/2)", f"least({lo} + side/2, 1024 - side/2)"
    held = f"CASE WHEN 1024 > side THEN {first} + ({last} - {first})*({_drawn(i)}) ELSE 512 END"
    return f"CASE WHEN b IS NULL THEN side/2 + (1024 - side)*({_drawn(i)}) ELSE least(greatest({held}, side/2), 1024 - side/2) END - side/2"


_QUAD = ", ".join(f"{a}0 + ({d}.0 + 0.06::DOUBLE*(2*({_drawn(n)})-1))*side AS q{a}{i}" for i, (dx, dy) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1))) for a, d, n in (("x", dx, 4 + 2 * i), ("y", dy, 5 + 2 * i)))
_BACK = ("e-qy0*h", "qx0*h-b1", "b1*qy0-qx0*e", "qy0*g-d", "a-qx0*g", "qx0*d-a*qy0", "d*h-e*g", "b1*g-a*h")
_VARIED = f"""{cte('v_det', 'v_photos')}, l AS (SELECT site_id, photo, list(struct_pack(x1 := x1, y1 := y1, x2 := x2, y2 := y2) ORDER BY x1, y1, x2, y2) AS boxes FROM v_det GROUP BY 1, 2),
i AS (SELECT p.site_id, p.photo AS k, coalesce(l.boxes, []) AS boxes FROM v_photos p LEFT JOIN l USING (site_id, photo)),
w0 AS (SELECT *, CASE WHEN len(boxes) > 0 THEN boxes[1 + CAST(floor(({_drawn(0)})*len(boxes)) AS BIGINT)] END AS b FROM i),
w1 AS (SELECT *, CASE WHEN b IS NULL THEN 1024*(0.3::DOUBLE + 0.7::DOUBLE*({_drawn(1)})) ELSE least(greatest(greatest(b.x2-b.x1, b.y2-b.y1)*(2.5::DOUBLE + 5.5::DOUBLE*({_drawn(1)})), 320), 1024) END AS side FROM w0),
w2 AS (SELECT *, {_middle("b.x1", "b.x2", 2)} AS x0, {_middle("b.y1", "b.y2", 3)} AS y0 FROM w1),
w3 AS (SELECT *, {_QUAD} FROM w2), w4 AS (SELECT *, qx1-qx2 AS dx1, qx3-qx2 AS dx2, qx0-qx1+qx2-qx3 AS sx, qy1-qy2 AS dy1, qy3-qy2 AS dy2, qy0-qy1+qy2-qy3 AS sy FROM w3),
w5 AS (SELECT *, (sx*dy2-dx2*sy)/(dx1*dy2-dx2*dy1) AS g, (dx1*sy-sx*dy1)/(dx1*dy2-dx2*dy1) AS h FROM w4),
w6 AS (SELECT *, qx1-qx0+g*qx1 AS a, qx3-qx0+h*qx3 AS b1, qy1-qy0+g*qy1 AS d, qy3-qy0+h*qy3 AS e FROM w5),
w7 AS (SELECT *, {", ".join(f"({v})*{640 if n < 6 else 1}/(a*e-b1*d) AS h{n}" for n, v in enumerate(_BACK))} FROM w6),
c0 AS (SELECT site_id, k, j, boxes[j] AS o, h0, h1, h2, h3, h4, h5, h6, h7 FROM (SELECT *, unnest(range(1, len(boxes) + 1)) AS j FROM w7)),
c1 AS (SELECT *, unnest([struct_pack(x := o.x1, y := o.y1), struct_pack(x := o.x2, y := o.y1), struct_pack(x := o.x2, y := o.y2), struct_pack(x := o.x1, y := o.y2)]) AS p FROM c0),
c2 AS (SELECT site_id, k, j, (h0*p.x+h1*p.y+h2)/(h6*p.x+h7*p.y+1) AS u, (h3*p.x+h4*p.y+h5)/(h6*p.x+h7*p.y+1) AS v FROM c1),
c3 AS (SELECT site_id, k, j, min(u) AS u1, min(v) AS v1, max(u) AS u2, max(v) AS v2 FROM c2 GROUP BY 1, 2, 3),
c4 AS (SELECT *, greatest(0, least(u1, 640)) AS a1, greatest(0, least(v1, 640)) AS b1, greatest(0, least(u2, 640)) AS a2, greatest(0, least(v2, 640)) AS b2 FROM c3),
c5 AS (SELECT site_id, k, count(*) AS kept, sum(a1+2*b1+3*a2+4*b2) AS places FROM c4 WHERE a2-a1 >= 10 AND b2-b1 >= 10 AND (a2-a1)*(b2-b1) >= 0.4*(u2-u1)*(v2-v1) GROUP BY 1, 2)"""


@query(f"""WITH {_VARIED} SELECT w7.site_id, w7.k, round(side, 6) AS side, round(x0, 6) AS x0, round(y0, 6) AS y0, {", ".join(f"round(h{n}, {5 if n in (2, 5) else 9 if n > 5 else 7}) AS h{n}" for n in range(8))}, coalesce(kept, 0) AS kept, round(coalesce(places, 0), 4) AS places
FROM w7 LEFT JOIN c5 USING (site_id, k)""")
def plan_variations(get):
    """Windows, transforms and what is left of all boxes."""
    box = F.struct("x1", "y1", "x2", "y2")
    b = get("v_det").groupBy("site_id", "photo").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    items = get("v_photos").join(b, ["site_id", "photo"], "left").select("site_id", F.col("photo").alias("k"), F.col("photo").cast("string").alias("name"), "width", "height", "boxes")
    got = dataset.plan_variations(items)
    places = F.aggregate("boxes", F.lit(0.0), lambda t, b: t + b.x1 + 2 * b.y1 + 3 * b.x2 + 4 * b.y2)
    return got.select(
        "site_id", "k", *(F.round(c, 6).alias(c) for c in ("side", "x0", "y0")), *(F.round(F.col("homography")[n], 5 if n in (2, 5) else 9 if n > 5 else 7).alias(f"h{n}") for n in range(8)),
        F.size("boxes").cast("long").alias("kept"), F.round(places, 4).alias("places"),
    )


_H = "SELECT det_id, x1, y1, x2, y2, CAST(1 AS DOUBLE) + CAST(det_id%5 AS DOUBLE)/10 AS h00, CAST(0.05 AS DOUBLE) AS h01, CAST(det_id%40 AS DOUBLE) - 20 AS h02, CAST(-0.04 AS DOUBLE) AS h10, CAST(1.1 AS DOUBLE) AS h11, CAST(det_id%30 AS DOUBLE) - 25 AS h12, CAST(0.0003 AS DOUBLE) AS h20, CAST(0.0002 AS DOUBLE) AS h21, CAST(1 AS DOUBLE) AS h22 FROM"


@query(f"""WITH {cte('v_det')}, h AS ({_H} v_det), c AS (SELECT *, unnest([struct_pack(x := x1, y := y1), struct_pack(x := x2, y := y1), struct_pack(x := x1, y := y2), struct_pack(x := x2, y := y2)]) AS k FROM h),
p AS (SELECT det_id, (h00*k.x+h01*k.y+h02)/(h20*k.x+h21*k.y+h22) AS u, (h10*k.x+h11*k.y+h12)/(h20*k.x+h21*k.y+h22) AS v FROM c),
b AS (SELECT det_id, min(u) AS a, min(v) AS b, max(u) AS c, max(v) AS d FROM p GROUP BY 1), w AS (SELECT *, greatest(0, least(a, 200)) AS x1, greatest(0, least(b, 200)) AS y1, greatest(0, least(c, 200)) AS x2, greatest(0, least(d, 200)) AS y2 FROM b)
SELECT det_id, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM w WHERE x2-x1 >= 10 AND y2-y1 >= 10 AND (x2-x1)*(y2-y1) >= 0.4*(c-a)*(d-b)""")
def warp_boxes(get):
    """P19."""
    got = dataset.warp_boxes(get("v_det").sparkSession.sql(f"{_H} {{d}}", d=get("v_det")), 200.0)
    return got.select("det_id", *(F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")))


# text, JSON, streams and metadata


@query("""WITH w AS (SELECT conv_id, turn, list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '') AS l FROM conversations), t AS (SELECT conv_id, turn, len(l) AS n, array_to_string(list_transform(list_filter(l, lambda x: length(x) >= 3), lambda x: upper(x)), ' ') AS s FROM w)
SELECT conv_id, turn, CASE WHEN n >= 10 THEN CAST(contains(s, 'THE') AS INT) + CAST(contains(s, 'ION') AS INT) + CAST(contains(s, 'LA') AS INT) END AS found FROM t""")
def keyword_check_words(get):
    """Words of three letters count as well read, turns of ten words as large."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: x != "")
    texts = F.transform(words, lambda x: F.struct(x.alias("text"), F.when(F.length(x) >= 3, 0.9).otherwise(0.1).alias("conf")))
    got = keyword_check(texts, F.array(F.lit("the"), F.lit("ion"), F.lit("la")), F.lit(0.9), F.size(words).cast("double"), least_side=10.0)
    return get("conversations").select("conv_id", "turn", F.size(got).alias("found")).withColumn("found", F.when(F.col("found") >= 0, F.col("found")))


@query(f"WITH {cte('v_det', 'v_photos')} SELECT p.site_id, p.photo, count(d.det_id) AS n, round(coalesce(sum(round(d.conf, 3)), 0), 3) AS conf FROM v_photos p LEFT JOIN v_det d ON d.photo = p.photo GROUP BY 1, 2")
def detections_round_trip(get):
    """To the JSON map and back; photos without boxes stay."""
    photos = get("v_photos").withColumn("photo", F.col("photo").cast("string"))
    out = io.detections_json(photos, get("v_det").withColumn("photo", F.col("photo").cast("string")))
    doc = out.select("site_id", F.lit("w").alias("weights"), F.create_map(F.lit("0"), F.lit("a")).alias("classes"), F.from_json("json", "map<string,array<array<double>>>").alias("detections"))
    dets, names, _ = io.detections_of(doc)
    rows = names.join(dets, ["site_id", "photo"], "left").groupBy("site_id", F.col("photo").cast("long").alias("photo"))
    return rows.agg(F.count("det_id").alias("n"), F.round(F.coalesce(F.sum("conf"), F.lit(0.0)), 3).alias("conf"))


@query(f"WITH {cte('v_det')} SELECT det_id, CAST(cls AS VARCHAR) || ' ' || printf('%.6f %.6f', (x1+x2)/2/200, (y1+y2)/2/200) AS line FROM v_det")
def yolo_lines(get):
    """Fractions that six digits give exactly."""
    side = F.lit(200.0)
    cx, cy, _, _ = bx.to_centre(Box.of(), side, side)
    return get("v_det").select("det_id", F.format_string("%d %.6f %.6f", "cls", cx, cy).alias("line"))


@query("SELECT page_id, starts_with(coalesce(html, ''), '<!') AS ok, starts_with(coalesce(html, ''), '%PDF-') AS pdf FROM pages")
def signatures(get):
    """Magic bytes of blobs."""
    c = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return get("pages").select("page_id", (F.substring(c, 1, 2) == F.lit(b"<!")).alias("ok"), io.check_signature(c, "pdf").alias("pdf"))


# pages of 1024 bytes end in four of checksum
@query("""WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents)
SELECT doc_id, md5(coalesce(list_aggregate([substr(h, CAST(2048*i+1 AS BIGINT), CASE WHEN length(h) > 2048*i+2048 THEN 2040 ELSE greatest(0, least(2040, length(h)-2048*i-8)) END) FOR i IN range((length(h)+2047)//2048)], 'string_agg', ''), '')) AS payload FROM h""")
def page_payload(get):
    """Texts as paged files, without the ends of their pages."""
    d = get("documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"), F.lit(0).cast("long").alias("offset"), F.lit(1 << 40).alias("length"))
    return ingest.page_payload(d).select("doc_id", F.md5(F.hex("payload").cast("binary")).alias("payload"))


@query(f"WITH {cte('v_images')} SELECT sweep, CAST(face AS INT) AS face, format('sweep{{:02d}}_face{{:d}}.jpg', sweep, face) AS photo, round(tx, 6) AS tx, round(fx, 3) AS fx FROM v_images WHERE sweep IN (SELECT sweep FROM v_images)")
def scan_metadata(get):
    """XML made of the cameras, read into sweeps and images again."""
    i = get("v_images")
    spec = lambda *c: F.format_string(*c)
    order = F.dense_rank().over(W.partitionBy("site_id").orderBy("sweep")) - 1
    s = i.select("site_id", "sweep").distinct().withColumn("n", order)
    body = spec("<vectorChild><guid>g%d</guid><name>scan  %d</name><points recordCount='%d'/></vectorChild>", F.col("sweep"), F.col("sweep"), F.col("n"))
    data = s.groupBy("site_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", body.alias("b")))), lambda x: x.b), "").alias("data"))
    img = spec(
        "<vectorChild><guid>i</guid><name>pic   %d</name><associatedData3DGuid>g%d</associatedData3DGuid><pose><translation><x>%s</x></translation></pose>"
        "<pinholeRepresentation><imageWidth>1024</imageWidth><imageHeight>1024</imageHeight><focalLength>5.12</focalLength><pixelWidth>0.01</pixelWidth><pixelHeight>0.01</pixelHeight></pinholeRepresentation></vectorChild>",
        F.col("face"), F.col("sweep"), F.col("tx").cast("string"),
    )
    images = i.groupBy("site_id").agg(F.array_join(F.collect_list(img), "").alias("images"))
    xml = data.join(images, "site_id").select("site_id", F.concat(F.lit("<e57Root xmlns='http://www.example.org/ns'><data3D>"), "data", F.lit("</data3D><images2D>"), "images", F.lit("</images2D></e57Root>")).alias("xml"))
    _, got = ingest.ingest_scan_metadata(xml)
    return got.select("sweep", "face", "photo", F.round("tx", 6).alias("tx"), F.round("fx", 3).alias("fx"))


def _arriving(get) -> DataFrame:
    box = F.struct(F.col("det_id").alias("o"), *(F.col(c).alias(c) for c in ("x1", "y1", "x2", "y2", "conf", "cls")), F.array().cast("array<struct<text:string,conf:double>>").alias("texts"))
    b = get("v_det").groupBy("site_id", "photo").agg(F.transform(F.array_sort(F.collect_list(box)), lambda x: F.struct(*(x[c].alias(c) for c in ("x1", "y1", "x2", "y2", "conf", "cls", "texts")))).alias("boxes"))
    return b.select("site_id", F.col("photo").cast("string").alias("photo"), F.lit(1024).alias("width"), F.lit(1024).alias("height"), "boxes")


@query(f"WITH {_CLEAN} SELECT CAST(photo AS VARCHAR) AS photo, count(*) AS n, round(sum(conf), 3) AS conf FROM d GROUP BY 1")
def arriving_photos(get):
    """R1's plan over a table of arriving photos; tests run it as a stream."""
    none = get("v_det").sparkSession.createDataFrame([], "name string, manufacturer string, description string, documents array<struct<doc_id:string>>, ocr_keywords array<string>")
    classes = get("v_det").select("cls").distinct().withColumn("product", F.lit("p"))
    got = stream.detect_photos(_arriving(get), classes, none)
    return got.groupBy("photo").agg(F.count("*").alias("n"), F.round(F.sum("conf"), 3).alias("conf"))


_SUBMITTED = f"""{_CLEAN}, n AS (SELECT photo, det_id AS id, row_number() OVER (PARTITION BY photo ORDER BY det_id) - 1 AS det_id FROM v_det),
s AS (SELECT d.site_id, d.photo, n.det_id, d.x1, d.y1, d.x2, d.y2, round(d.conf, 3) AS conf, d.cls, d.conf AS raw, d.det_id AS id, least(CAST(1 AS DOUBLE), CAST(6000 AS DOUBLE)/CASE WHEN d.photo%2 = 0 THEN 4096 ELSE 9000 END) AS shrink FROM d JOIN n ON n.photo = d.photo AND n.id = d.det_id),
b AS (SELECT *, round_even(x1/shrink, 0) AS a1, round_even(y1/shrink, 0) AS b1, round_even(x2/shrink, 0) AS a2, round_even(y2/shrink, 0) AS b2 FROM s)"""


@query(f"""WITH {_SUBMITTED} SELECT CAST(photo AS VARCHAR) AS photo, det_id, a1 AS x1, b1 AS y1, a2 AS x2, b2 AS y2, conf, 'relay ' || cls AS product, CASE WHEN cls < 2 THEN 'maker' END AS manufacturer, CASE WHEN cls < 2 THEN 1 + cls ELSE 0 END AS n_documents,
CASE WHEN cls = 0 AND conf >= 0.25 AND least(a2-a1, b2-b1) >= 60 THEN CASE WHEN id%4 = 0 THEN 'REF' WHEN id%4 = 1 THEN 'REF,615' ELSE '' END END AS keywords FROM b""")
def submitted_photos(get):
    """Photos of 4,096 and 9,000 pixels, the latter shrunk, with products, documents and words on their plates."""
    said = F.when(F.col("det_id") % 4 == 0, "ref").when(F.col("det_id") % 4 == 1, "Ref 615").otherwise("none")
    texts = F.array(F.struct(said.alias("text"), F.lit(0.9).alias("conf")), F.struct(F.lit("615").alias("text"), F.lit(0.1).alias("conf")))
    box = F.struct(F.col("det_id").alias("o"), *(F.col(c).alias(c) for c in ("x1", "y1", "x2", "y2", "conf", "cls")), texts.alias("texts"))
    b = get("v_det").groupBy("site_id", "photo").agg(F.transform(F.array_sort(F.collect_list(box)), lambda x: F.struct(*(x[c].alias(c) for c in ("x1", "y1", "x2", "y2", "conf", "cls", "texts")))).alias("boxes"))
    side = F.when(F.col("photo") % 2 == 0, 4096).otherwise(9000)
    photos = b.select("site_id", F.col("photo").cast("string").alias("photo"), side.alias("width"), F.lit(1024).alias("height"), "boxes")
    classes = get("v_det").select("cls").distinct().withColumn("product", F.concat(F.lit("relay "), F.col("cls")))
    documents = F.transform(F.sequence(F.lit(0), F.col("cls")), lambda i: F.struct(F.concat(F.lit("d"), i).alias("doc_id")))
    words = F.when(F.col("cls") == 0, F.array(F.lit("REF"), F.lit("615"))).otherwise(F.array().cast("array<string>"))
    products = classes.filter("cls < 2").select(F.col("product").alias("name"), F.lit("maker").alias("manufacturer"), F.lit("text").alias("description"), documents.alias("documents"), words.alias("ocr_keywords"))
    got = stream.detect_photos(photos, classes, products)
    return got.select("photo", "det_id", "x1", "y1", "x2", "y2", "conf", "product", "manufacturer", F.size("documents").alias("n_documents"), F.array_join("keywords", ",").alias("keywords"))


# files: each query writes its rows as files of the shared folder and reads them back


@query("SELECT c_name AS photo, c_custkey AS id, row_number() OVER (ORDER BY c_name) AS rank FROM customer")
def sorted_photos(get):
    """Photos by name, written in order; a row's rank is its place in the files."""
    rows = get("customer").select(F.col("c_name").alias("photo"), F.col("c_custkey").alias("id"))
    path = shared.new_path(rows.sparkSession, "sorted-photos")
    io.write_sorted(rows, path, "photo")
    return io.read_sorted(rows.sparkSession, path)


@query("SELECT 0 AS site_id, c_custkey % 7 AS kind, c_custkey AS object_id, row_number() OVER (ORDER BY c_custkey % 7, c_custkey) AS rank FROM customer")
def sorted_objects(get):
    """Objects by kind and id."""
    rows = get("customer").select(F.lit(0).alias("site_id"), (F.col("c_custkey") % 7).alias("kind"), F.col("c_custkey").alias("object_id"))
    path = shared.new_path(rows.sparkSession, "sorted-objects")
    io.write_sorted(rows, path, "kind", "object_id")
    return io.read_sorted(rows.sparkSession, path)


@query(f"""WITH {cte('v_det', 'v_photos')}, b AS (SELECT *, row_number() OVER (PARTITION BY photo ORDER BY det_id) - 1 AS n FROM v_det)
SELECT p.site_id, p.photo, b.n AS det_id, round(x1, 3) AS x1, round(y1, 3) AS y1, round(x2, 3) AS x2, round(y2, 3) AS y2, round(conf, 3) AS conf, cls, CASE WHEN cls IS NOT NULL THEN 'relay ' || cls END AS product FROM v_photos p LEFT JOIN b ON p.photo = b.photo""")
def detection_files(get):
    """A document per photo, photos without boxes among them, and the names of classes."""
    name = F.col("photo").cast("string").alias("photo")
    photos, dets = get("v_photos").select("site_id", name), get("v_det").withColumn("photo", F.col("photo").cast("string"))
    classes = get("v_det").select("cls", F.concat(F.lit("relay "), "cls").alias("product")).distinct()
    path = shared.new_path(photos.sparkSession, "detections")
    io.write_detections(photos, dets, path, classes, "w.pt")
    got, names, kinds = io.read_detections(photos.sparkSession, path, lines=True)
    rows = names.join(got, ["site_id", "photo"], "left").join(kinds, ["site_id", "cls"], "left")
    return rows.select("site_id", F.col("photo").cast("long").alias("photo"), "det_id", "x1", "y1", "x2", "y2", "conf", "cls", "product")


@query(f"WITH {cte('v_images')} SELECT site_id, format('sweep{{:02d}}_face{{:d}}.jpg', sweep, face) AS photo, sweep, face, width, height, fx, fy, cx, cy, qw, qx, qy, qz, round(tx, 9) AS tx, round(ty, 9) AS ty, round(tz, 9) AS tz FROM v_images")
def pose_files(get):
    """S3: cameras as a pose document per site."""
    i = get("v_images").withColumn("file", geo.photo_name(F.col("sweep"), F.col("face")))
    one = F.struct("file", "sweep", "face", "width", "height", "fx", "fy", "cx", "cy", F.array("qw", "qx", "qy", "qz").alias("rotation_wxyz"), F.array("tx", "ty", "tz").alias("translation_xyz"))
    turn = F.struct(F.col("sweep").alias("index"), F.format_string("s%d", "sweep").alias("name"), F.lit(7).cast("long").alias("points"), F.array("qw", "qx", "qy", "qz").alias("rotation_wxyz"), F.array("tx", "ty", "tz").alias("translation_xyz"))
    docs = i.groupBy("site_id").agg(F.collect_list(turn).alias("sweeps"), F.collect_list(one).alias("images"))
    path = shared.new_path(i.sparkSession, "poses")
    io.write_records(docs, path)
    _, images = io.read_poses(i.sparkSession, path)
    return images.withColumns({a: F.round(a, 9) for a in ("tx", "ty", "tz")})


_ENTRIES = "SELECT s_name AS tag_name, 'P, ' || s_suppkey AS panel, 'feeder \"' || s_suppkey%7 || '\"' AS panel_function, 'C' || s_suppkey%9 AS cabinet, x, y, z, DATE '2024-01-01' + CAST(s_suppkey%300 AS INT) AS last_inspection, CASE WHEN s_suppkey%3 = 0 THEN NULL ELSE DATE '2025-01-01' + CAST(s_suppkey%200 AS INT) END AS next_inspection, CASE WHEN s_suppkey%5 = 0 THEN NULL ELSE 'note é' || s_suppkey END AS maintenance_note FROM supplier JOIN v_register ON entry_id = s_suppkey"


@query(f"WITH {cte('v_register')} SELECT * REPLACE (CAST(last_inspection AS VARCHAR) AS last_inspection, CAST(next_inspection AS VARCHAR) AS next_inspection) FROM ({_ENTRIES})")
def register_files(get):
    """The register as CSV, with quotes, commas and missing cells."""
    rows = get("supplier").sparkSession.sql(_ENTRIES.replace("supplier", "{s}").replace("v_register", "{r}").replace('\\"', '"'), s=get("supplier"), r=get("v_register"))
    path = shared.new_path(rows.sparkSession, "register")
    rows.write.option("header", True).option("escape", '"').csv(path)
    got = io.read_register(rows.sparkSession, path).drop("entry_id", "entry_order")
    return got.withColumns({c: F.col(c).cast("string") for c in ("last_inspection", "next_inspection")})


@query("""WITH p AS (SELECT 'relay ' || s_suppkey%70 AS name, format('folder=p{:06d}', s_suppkey) AS product_id, s_name AS manufacturer, s_suppkey%3 AS n FROM supplier)
SELECT name, product_id, manufacturer, n AS n_documents, CASE WHEN n > 0 THEN 'doc-0' END AS first_document FROM p QUALIFY row_number() OVER (PARTITION BY name ORDER BY product_id DESC) = 1""")
def product_files(get):
    """A document per product folder; of equal names the later file counts."""
    k = F.col("s_suppkey")
    doc = lambda i: F.struct(F.lit("t").alias("title"), F.lit("pdf").alias("type"), F.concat(F.lit("doc-"), i).alias("doc_id"), F.lit("u").alias("url"), F.lit(None).cast("string").alias("embed_url"))
    docs = F.transform(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda i: i < k % 3), doc)
    rows = get("supplier").select(F.format_string("p%06d", k).alias("folder"), F.concat(F.lit("relay "), k % 70).alias("name"), F.col("s_name").alias("manufacturer"), F.lit("s").alias("series"), F.lit("d").alias("description"), F.array(F.lit("REF")).alias("ocr_keywords"), docs.alias("documents"))
    path = shared.new_path(rows.sparkSession, "products")
    rows.repartition("folder").write.partitionBy("folder").json(path)
    got = io.read_products(rows.sparkSession, path)
    return got.select("name", "product_id", "manufacturer", F.size("documents").alias("n_documents"), F.get("documents", F.lit(0))["doc_id"].alias("first_document"))


@query("""SELECT CAST(c_custkey AS VARCHAR) || '.jpg' AS name, CASE WHEN c_custkey%5 > 0 THEN c_custkey%5 - 1 END AS n, CASE WHEN c_custkey%5 > 1 THEN CAST(c_custkey%8 AS DOUBLE)/8 END AS x1 FROM customer""")
def photo_label_files(get):
    """Label documents of web photos, with comments, empty lists and photos left out on purpose."""
    k = F.col("c_custkey")
    one = F.array((k % 8).cast("double") / 8, F.lit(0.5), F.lit(0.75), F.lit(1.0))
    text = F.when(k % 5 == 0, F.lit("null")).otherwise(F.to_json(F.array_repeat(one, (k % 5 - 1).cast("int"))))
    entry = F.concat(F.lit('"'), k.cast("string"), F.lit('.jpg": '), text)
    docs = get("customer").groupBy((k % 40).alias("part")).agg(F.concat(F.lit('{"_comment": "c", '), F.array_join(F.collect_list(entry), ", "), F.lit("}")).alias("value"))
    path = shared.new_path(docs.sparkSession, "photo-labels")
    docs.repartition("part").write.partitionBy("part").text(path)
    got = io.read_photo_labels(docs.sparkSession, path + "/*")
    return got.select("name", F.when(F.col("boxes").isNotNull(), F.size("boxes")).alias("n"), F.get("boxes", F.lit(0))[0].alias("x1"))


@query(f"WITH {_STRICT} SELECT photo, object_id, model, CAST(round_even(a1, 0) AS INT) AS x1, CAST(round_even(b2, 0) AS INT) AS y2, CAST(round_even(angle, 0) AS INT) AS view_angle_deg, difficulty FROM shown")
def truth_files(get):
    """Objects as JSON and appearances as CSV, put together again."""
    objects = _objects(get)
    seen = _appearances(get)
    path = shared.new_path(objects.sparkSession, "truth")
    io.write_ground_truth(objects, seen, path)
    back = objects.sparkSession.read.option("header", True).schema(seen.schema).csv(f"{path}/appearances").drop("model")
    models = objects.sparkSession.read.schema(objects.schema).json(f"{path}/objects").select("object_id", "model")
    return back.join(models, "object_id").select("photo", "object_id", "model", "x1", "y2", "view_angle_deg", "difficulty")


# from clusters to records, tags and a report

#: Places and confidences moved a little, so that no third digit stands on the edge of rounding.
_MOVED = {"x": "x + CAST(0.00017 AS DOUBLE)*(det_id%13)", "y": "y + CAST(0.00019 AS DOUBLE)*(det_id%11)", "z": "z + CAST(0.00023 AS DOUBLE)*(det_id%7)", "conf": "conf + CAST(0.000013 AS DOUBLE)*(det_id%17)"}
_KEPT = _KEEP.replace("v_clustered AS (", "raw AS (", 1).replace(", c AS (", f", v_clustered AS (SELECT * REPLACE ({', '.join(f'{e} AS {c}' for c, e in _MOVED.items())}) FROM raw), c AS (", 1)
_RECORD = f"""{_KEPT}, s AS (SELECT v.*, sqrt((v.x-px)*(v.x-px)+(v.y-py)*(v.y-py)+(v.z-pz)*(v.z-pz)) AS off, (x2-x1)*(y2-y1)*conf*CASE WHEN x1 <= 2 OR y1 <= 2 OR x2 >= 1022 OR y2 >= 1022 THEN CAST(0.2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS q FROM c JOIN v_clustered v USING (site_id, cls, cluster)),
b AS (SELECT site_id, cls, cluster, photo AS best_photo, x1 AS bx FROM s QUALIFY row_number() OVER (PARTITION BY site_id, cls, cluster ORDER BY q DESC, join_no) = 1),
g AS (SELECT site_id, cls, cluster, round(max(off), 3) AS spread_m, CAST(list(photo ORDER BY join_no) AS VARCHAR) AS photos, round(sum(round(conf, 3)), 3) AS confs FROM s GROUP BY 1, 2, 3),
r AS (SELECT c.site_id, format('asset-{{:02d}}', row_number() OVER (PARTITION BY c.site_id ORDER BY c.cls, round_even(px, 1), round_even(py, 1), round_even(pz, 1), c.cluster)) AS asset_id, row_number() OVER (PARTITION BY c.site_id ORDER BY c.cls, round_even(px, 1), round_even(py, 1), round_even(pz, 1), c.cluster) AS asset_no,
 'relay ' || c.cls AS product, c.cls AS class_id, round(px, 3) AS x, round(py, 3) AS y, round(pz, 3) AS z, sightings, sweeps, round(mc, 3) AS mean_confidence, round(xc, 3) AS max_confidence, spread_m, best_photo, CAST(bx AS INT) AS bx, photos, confs
 FROM c JOIN g USING (site_id, cls, cluster) JOIN b USING (site_id, cls, cluster) WHERE sweeps >= 5)"""


def _records(get) -> DataFrame:
    clustered = get("v_clustered").withColumns({c: F.expr(e) for c, e in _MOVED.items()})
    best = A.best_view(clustered, _KEYS, F.lit(1024.0), F.lit(1024.0), F.col("join_no"))
    classes = clustered.select("cls", F.concat(F.lit("relay "), "cls").alias("product")).distinct()
    return A.asset_records(A.number_assets(A.assets_from_clusters(clustered, _KEYS)), best, classes)


@query(f"WITH {_RECORD} SELECT * FROM r")
def asset_records(get):
    """Records of assets, written as JSON and read back."""
    rows = _records(get)
    path = shared.new_path(rows.sparkSession, "assets")
    io.write_records(rows, path)
    got = rows.sparkSession.read.schema(rows.schema).json(path)
    ids = F.concat(F.lit("["), F.array_join(F.transform("seen_in", lambda m: m.photo.cast("string")), ", "), F.lit("]"))
    confs = F.round(F.aggregate("seen_in", F.lit(0.0), lambda t, m: t + m.conf), 3)
    return got.select("site_id", "asset_id", "asset_no", "product", "class_id", "x", "y", "z", "sightings", F.size("sweeps").cast("long").alias("sweeps"), "mean_confidence", "max_confidence", "spread_m", "best_photo", F.col("best_box")[0].alias("bx"), ids.alias("photos"), confs.alias("confs"))


_LINKED = f"""{_RECORD}, {cte('v_register')}, near AS (SELECT r.site_id, r.asset_id, r.asset_no, e.entry_id, sqrt((r.x-e.x)*(r.x-e.x)+(r.y-e.y)*(r.y-e.y)+(r.z-e.z)*(r.z-e.z)) AS distance FROM r JOIN v_register e ON r.site_id = e.site_id),
first AS (SELECT * FROM near WHERE distance <= 2 QUALIFY row_number() OVER (PARTITION BY site_id, asset_id ORDER BY distance, entry_id) = 1),
won AS (SELECT * FROM first QUALIFY row_number() OVER (PARTITION BY site_id, entry_id ORDER BY asset_no) = 1)"""


def _linked(get) -> DataFrame:
    return link.link_register(_records(get), get("v_register"), 2.0)


@query(f"""WITH {_LINKED} SELECT r.site_id, r.asset_id AS id, coalesce(e.tag_name, 'Unregistered ' || r.product) AS title, w.entry_id IS NOT NULL AS registered, CASE WHEN w.entry_id IS NOT NULL THEN 'P' || w.entry_id END AS panel, r.product, CASE WHEN class_id = 0 THEN 'maker' END AS manufacturer,
 CASE WHEN class_id = 0 THEN 'd0' END AS document, CASE WHEN w.entry_id IS NOT NULL THEN 'n' || w.entry_id END AS note, r.x, r.y, r.z, sightings, sweeps AS scan_positions, mean_confidence, CAST(best_photo AS VARCHAR) AS best_photo
FROM r LEFT JOIN won w USING (site_id, asset_id) LEFT JOIN v_register e ON e.site_id = r.site_id AND e.entry_id = w.entry_id""")
def tag_records(get):
    """Tags of located assets within 2 m of an entry, written as JSON and read back."""
    register = get("v_register").select("*", F.concat(F.lit("P"), "entry_id").alias("panel"), F.lit("f").alias("panel_function"), F.lit("c").alias("cabinet"), F.lit(None).cast("date").alias("last_inspection"), F.lit(None).cast("date").alias("next_inspection"), F.concat(F.lit("n"), "entry_id").alias("maintenance_note"))
    products = register.sparkSession.range(1).select(F.lit("relay 0").alias("name"), F.lit("maker").alias("manufacturer"), F.lit("text").alias("description"), F.array(F.struct(F.lit("d0").alias("doc_id"))).alias("documents"))
    linked = link.link_products(link.link_register(_records(get), register, 2.0), products).withColumn("best_photo", F.col("best_photo").cast("string"))
    tags = link.build_tags(linked, register)
    path = shared.new_path(register.sparkSession, "tags")
    io.write_records(tags, path)
    t = register.sparkSession.read.schema(tags.schema).json(path)
    return t.select(
        "site_id", "id", "title", "registered", "panel", "product", "manufacturer", F.get("documents", F.lit(0))["doc_id"].alias("document"), F.col("maintenance.note").alias("note"), *(F.col("position_xyz")[i].alias(a) for i, a in enumerate("xyz")),
        F.col("detection.sightings").alias("sightings"), F.col("detection.scan_positions").cast("long").alias("scan_positions"), F.col("detection.mean_confidence").alias("mean_confidence"), F.col("detection.best_photo").alias("best_photo"),
    )


@query(f"""WITH {_LINKED}, o AS (SELECT site_id, entry_id AS object_id, x, y, z FROM v_register), near_o AS (SELECT r.site_id, r.asset_id, o.object_id, sqrt((r.x-o.x)*(r.x-o.x)+(r.y-o.y)*(r.y-o.y)+(r.z-o.z)*(r.z-o.z)) AS d FROM r JOIN o ON r.site_id = o.site_id),
hit AS (SELECT DISTINCT site_id, object_id FROM (SELECT * FROM near_o WHERE d < 1 QUALIFY row_number() OVER (PARTITION BY site_id, asset_id ORDER BY d, object_id) = 1))
SELECT s.site_id, (SELECT count(*) FROM r WHERE r.site_id = s.site_id) AS assets, (SELECT count(*) FROM won WHERE won.site_id = s.site_id) AS registered,
 (SELECT coalesce(string_agg(tag_name, ',' ORDER BY entry_id), '') FROM v_register e WHERE e.site_id = s.site_id AND entry_id NOT IN (SELECT entry_id FROM won WHERE won.site_id = s.site_id)) AS not_found,
 (SELECT count(*) FROM o WHERE o.site_id = s.site_id) AS objects, (SELECT count(*) FROM hit WHERE hit.site_id = s.site_id) AS located
FROM (SELECT site_id FROM r UNION SELECT site_id FROM v_register) s""")
def site_reports(get):
    """What a run found and what it did not, per site; register entries stand for objects, too."""
    objects = get("v_register").select("site_id", F.col("entry_id").alias("object_id"), "x", "y", "z")
    linked = _linked(get)
    got = link.site_report(linked, get("v_register"), link.compare_to_truth(_records(get), objects, 1.0), objects)
    return got.select("site_id", "assets", "registered", F.array_join("register_entries_not_found", ",").alias("not_found"), "objects", F.col("located").cast("long").alias("located"))


def _predictor():
    """A model of arithmetic: one box per tile, of its photo, scale and place."""

    def boxes(tiles):
        photo, x0, y0, w, h = (tiles[c].to_numpy() for c in ("photo", "x0", "y0", "tile_w", "tile_h"))
        k = photo * 131 + x0 * 7 + y0 * 3 + (tiles["scale"].to_numpy() * 4).astype("int64") * 17
        x, y = (k % 13) * w.astype("float64") / 16, (k % 11) * h.astype("float64") / 16
        return {"row": range(len(k)), "x1": x, "y1": y, "x2": x + w.astype("float64") / 4, "y2": y + h.astype("float64") / 4, "conf": (100 + k % 850) / 1000, "cls": k % 3}

    return boxes


_TILES = ORACLES["plan_tiles"].removeprefix("WITH ")
_PREDICTED = f"""{_TILES.replace("\nSELECT site_id, photo, scale, CAST(x0 AS INT) AS x0", ",\nt AS (SELECT w AS width, h AS height, site_id, photo, scale, CAST(x0 AS INT) AS x0")}),
kk AS (SELECT *, photo*131 + x0*7 + y0*3 + CAST(scale*4 AS BIGINT)*17 AS n FROM t), m AS (SELECT *, CAST(n%13*tile_w AS DOUBLE)/16 AS x1, CAST(n%11*tile_h AS DOUBLE)/16 AS y1, CAST(100 + n%850 AS DOUBLE)/1000 AS conf, CAST(n%3 AS INT) AS cls FROM kk),
pp AS (SELECT *, x1 + CAST(tile_w AS DOUBLE)/4 AS x2, y1 + CAST(tile_h AS DOUBLE)/4 AS y2 FROM m),
u AS (SELECT site_id, photo, (x1+x0)/scale AS x1, (y1+y0)/scale AS y1, (x2+x0)/scale AS x2, (y2+y0)/scale AS y2, conf, cls FROM pp WHERE (x1 >= 4 OR x0 = 0) AND (y1 >= 4 OR y0 = 0) AND (x2 <= tile_w-4 OR x0+tile_w >= width*scale-1) AND (y2 <= tile_h-4 OR y0+tile_h >= height*scale-1)),
ud AS (SELECT *, row_number() OVER (PARTITION BY site_id, photo ORDER BY conf DESC, x1, y1, x2, y2, cls) - 1 AS det_id FROM u), {_LISTS.replace("v_det", "ud")}, {_NMS}, {_CONTAINED}"""


@query(f"WITH {_PREDICTED} SELECT site_id, photo, det_id, round(x1, 6) AS x1, round(y2, 6) AS y2, conf, cls FROM (SELECT site_id, photo, unnest(l, recursive := true) FROM clean)")
def predicted_boxes(get):
    """P10 to P12, section 2.10, W1, W2: from photos over tiles and a model to clean boxes."""
    photos = get("v_photos").select("site_id", "photo", F.expr("CAST(500 + photo*97%3600 AS INT) AS width"), F.expr("CAST(400 + photo*53%3600 AS INT) AS height"))
    # a photo is a few bytes and many tiles
    photos = shared.dealt(photos, "site_id", "photo")
    found = tiles.untile_boxes(tiles.predict_tiles(tiles.plan_tiles(photos, tiles.scales_for()), _predictor, name="arithmetic"))
    order = W.partitionBy("site_id", "photo").orderBy(F.col("conf").desc(), "x1", "y1", "x2", "y2", "cls")
    clean = nms.suppress(found.withColumn("det_id", (F.row_number().over(order) - 1).cast("long")))
    return clean.select("site_id", "photo", "det_id", F.round("x1", 6).alias("x1"), F.round("y2", 6).alias("y2"), "conf", "cls")
