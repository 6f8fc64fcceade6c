"""Settings kept as delimited text: frames, crops, names, paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.ledger import FINAL
from ..plans.plan import Plan

#: Well-formed frames of a batch: four numbers each, in order.
FRAMES_SPARK = """fr AS (SELECT batch_id, frame_ref_w, frame_ref_h, pos, try_cast(p[0] AS DOUBLE) AS x, try_cast(p[1] AS DOUBLE) AS y, try_cast(p[2] AS DOUBLE) AS w, try_cast(p[3] AS DOUBLE) AS h
    FROM (SELECT batch_id, frame_ref_w, frame_ref_h, pos, split(f, ',') AS p FROM (SELECT batch_id, frame_ref_w, frame_ref_h, posexplode(split(fixed_frames, ';')) AS (pos, f) FROM batch) a) b WHERE size(p) = 4),
    ok AS (SELECT *, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY pos) AS INT) AS n, CAST(count(*) OVER (PARTITION BY batch_id) AS INT) AS total FROM fr WHERE x IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL AND h IS NOT NULL)"""
FRAMES_DUCKDB = """s AS (SELECT batch_id, frame_ref_w, frame_ref_h, string_split(fixed_frames, ';') AS fs FROM batch WHERE fixed_frames IS NOT NULL),
    a AS (SELECT batch_id, frame_ref_w, frame_ref_h, unnest(range(len(fs))) AS pos, unnest(fs) AS f FROM s), b AS (SELECT *, string_split(f, ',') AS p FROM a),
    fr AS (SELECT batch_id, frame_ref_w, frame_ref_h, pos, try_cast(p[1] AS DOUBLE) AS x, try_cast(p[2] AS DOUBLE) AS y, try_cast(p[3] AS DOUBLE) AS w, try_cast(p[4] AS DOUBLE) AS h FROM b WHERE len(p) = 4),
    ok AS (SELECT *, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY pos) AS INT) AS n, CAST(count(*) OVER (PARTITION BY batch_id) AS INT) AS total FROM fr WHERE x IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL AND h IS NOT NULL)"""

#: A stored crop as four corners in an image of 1000 x 800: eight numbers are a quad, four a rectangle truncated, not below 0 and not beyond the image's end, else the whole image.
_CROP = """cq AS (SELECT job_id, CASE WHEN k = 8 AND good = 8 THEN 'quad' WHEN k = 4 AND good = 4 THEN 'rect' ELSE 'whole' END AS kind, n1, n2, n3, n4, n5, n6, n7, n8 FROM cn),
    cr AS (SELECT job_id, kind, greatest(CAST(trunc_(n1) AS INT), 0) AS rx, greatest(CAST(trunc_(n2) AS INT), 0) AS ry, CAST(trunc_(n3) AS INT) AS rw, CAST(trunc_(n4) AS INT) AS rh, n1, n2, n3, n4, n5, n6, n7, n8 FROM cq),
    cs AS (SELECT *, CASE kind WHEN 'rect' THEN least(rw, 1000 - rx) ELSE 1000 END AS cw, CASE kind WHEN 'rect' THEN least(rh, 800 - ry) ELSE 800 END AS ch FROM cr),
    crop AS (SELECT job_id, kind, CASE kind WHEN 'quad' THEN n1 WHEN 'rect' THEN CAST(rx AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS x1, CASE kind WHEN 'quad' THEN n2 WHEN 'rect' THEN CAST(ry AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS y1,
       CASE kind WHEN 'quad' THEN n3 WHEN 'rect' THEN CAST(rx + cw AS DOUBLE) ELSE CAST(1000 AS DOUBLE) END AS x2, CASE kind WHEN 'quad' THEN n4 WHEN 'rect' THEN CAST(ry AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS y2,
       CASE kind WHEN 'quad' THEN n5 WHEN 'rect' THEN CAST(rx + cw AS DOUBLE) ELSE CAST(1000 AS DOUBLE) END AS x3, CASE kind WHEN 'quad' THEN n6 WHEN 'rect' THEN CAST(ry + ch AS DOUBLE) ELSE CAST(800 AS DOUBLE) END AS y3,
       CASE kind WHEN 'quad' THEN n7 WHEN 'rect' THEN CAST(rx AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS x4, CASE kind WHEN 'quad' THEN n8 WHEN 'rect' THEN CAST(ry + ch AS DOUBLE) ELSE CAST(800 AS DOUBLE) END AS y4 FROM cs)"""


def _numbers(get: str, size: str, split: str) -> str:
    cols = ", ".join(f"try_cast({get.format(i=i)} AS DOUBLE) AS n{i}" for i in range(1, 9))
    good = " + ".join(f"CASE WHEN n{i} IS NULL THEN 0 ELSE 1 END" for i in range(1, 9))
    return f"ca AS (SELECT job_id, {split} AS p FROM capture_job), cb AS (SELECT job_id, {size}(p) AS k, {cols} FROM ca), cn AS (SELECT *, {good} AS good FROM cb)"


#: The same in Spark over arrays of numbers, which makes methods small enough to be compiled.
CROP_SPARK = f"""ca AS (SELECT job_id, transform(split(left_crop_box, ','), v -> try_cast(v AS DOUBLE)) AS p FROM capture_job), cq AS (SELECT job_id, p, CASE WHEN size(p) IN (4, 8) AND forall(p, v -> v IS NOT NULL) THEN CASE size(p) WHEN 8 THEN 'quad' ELSE 'rect' END ELSE 'whole' END AS kind FROM ca),
    cr AS (SELECT job_id, kind, p, greatest(CAST(get(p, 0) AS INT), 0) AS rx, greatest(CAST(get(p, 1) AS INT), 0) AS ry FROM cq),
    cs AS (SELECT job_id, kind, CASE kind WHEN 'quad' THEN p WHEN 'rect' THEN array(rx, ry, rx + least(CAST(get(p, 2) AS INT), 1000 - rx), ry, rx + least(CAST(get(p, 2) AS INT), 1000 - rx), ry + least(CAST(get(p, 3) AS INT), 800 - ry), rx, ry + least(CAST(get(p, 3) AS INT), 800 - ry)) ELSE array(0D, 0D, 1000D, 0D, 1000D, 800D, 0D, 800D) END AS q FROM cr),
    crop AS (SELECT job_id, kind, {", ".join(f"get(q, {2 * i}) AS x{i + 1}, get(q, {2 * i + 1}) AS y{i + 1}" for i in range(4))} FROM cs)"""
CROP_DUCKDB = _numbers("p[{i}]", "len", "string_split(left_crop_box, ',')") + ", " + _CROP.replace("trunc_(", "trunc(")

_BASE = "regexp_replace(regexp_replace(original_path, '^.*/', ''), '[.][^.]*$', '')"
_DIR = "regexp_replace(original_path, '[^/]*$', '')"

#: Files under the names of the originals that they may derive from: without the ending, and without a known suffix and the ending.
_SUFFIX, _ENDING = "(_processed|_1_left|_2_right|_frame[0-9]+)[.][^.]+$", "[.][^.]+$"
_NAMES = f"CASE WHEN matches_(file, '{_SUFFIX}') THEN regexp_replace(file, '{_SUFFIX}', '') END, CASE WHEN matches_(file, '{_ENDING}') THEN regexp_replace(file, '{_ENDING}', '') END"
_FILES = f"lf AS (SELECT path, {_DIR.replace('original_path', 'path')} AS dir, lower(regexp_replace(path, '^.*/', '')) AS file FROM listing)"
#: Folder, name and ending of a path, without regular expressions; what is left of a name without its ending.
_FILE = "substring_index({p}, '/', -1)"
_PARTS = "left({p}, length({p}) - length(" + _FILE + ")) AS dir, lower(" + _FILE + ") AS file"
_STEM = "CASE WHEN instr(file, '.') > 0 THEN left(file, length(file) - length(substring_index(file, '.', -1)) - 1) ELSE file END"
#: Files under the names of originals, folder included. Names come out of explode(), for originals too: Spark tests the keys of a join for nulls, and would push
#: the tests down to where paths are made and make them anew for each. Joins compare a hash first, as paths of an archive begin alike, which makes sorting them slow.
NAMED_SPARK = f"""lf AS (SELECT path, {_PARTS.format(p="path")} FROM listing), le AS (SELECT *, substring_index(file, '.', -1) AS ending, {_STEM} AS stem FROM lf),
    lx AS (SELECT *, instr(file, '.') > 0 AND ending <> '' AS ends, CASE WHEN endswith(stem, '_processed') THEN '_processed' WHEN endswith(stem, '_1_left') THEN '_1_left' WHEN endswith(stem, '_2_right') THEN '_2_right' WHEN contains(stem, '_frame') THEN regexp_extract(stem, '(_frame[0-9]+)$', 1) ELSE '' END AS suffix FROM le),
    ln AS (SELECT path, explode(CASE WHEN NOT ends OR path IS NULL THEN array() WHEN suffix = '' THEN array(concat(dir, stem)) ELSE array(concat(dir, stem), concat(dir, left(stem, length(stem) - length(suffix)))) END) AS name FROM lx)"""
_ORIGINALS = f"(SELECT *, {_STEM} AS base FROM (SELECT *, {_PARTS.format(p='original_path')} FROM {{of}}) o0)"
_FOLDER = "left({p}, length({p}) - length(" + _FILE + "))"
_ROOT = "CASE WHEN endswith({d}, 'Processed/') THEN left({d}, length({d}) - 10) ELSE {d} END"
#: Where each job looks, and the listing's files under the names they answer to: one join. A folder and its Processed/ are one place, so that a job looks
#: once for originals and what derives from them, and once for each recorded output; what tier a file is of is seen when they have met.
RESOLVED_SPARK = f"""kf AS (SELECT path, stem, suffix, {_ROOT.format(d="dir")} AS root, ends AND ending IN ('tif', 'tiff', 'jpg', 'jpeg', 'png') AS image FROM lx),
    kl AS (SELECT path, image, inline(CASE WHEN image AND suffix <> '' THEN array(struct(root, stem AS base), struct(root, left(stem, length(stem) - length(suffix)) AS base)) ELSE array(struct(root, stem AS base)) END) FROM kf),
    kw AS (SELECT job_id, inline(concat(transform(array_distinct(array({_ROOT.format(d="dir")}, dir)), r -> struct(0 AS first_tier, original_path AS wanted, r AS root, base)),
        transform(CASE WHEN processed_path IS NULL THEN array() ELSE split(processed_path, ';') END, p -> struct(1 AS first_tier, p AS wanted, {_ROOT.format(d=_FOLDER.format(p="p"))} AS root, {_STEM.replace("file", "lower(" + _FILE.format(p="p") + ")")} AS base)))) FROM {_ORIGINALS.format(of="f")} o),
    u AS (SELECT job_id, path, CASE WHEN first_tier = 1 THEN CASE WHEN path = wanted THEN 1 END WHEN path = wanted THEN 4 WHEN NOT image THEN NULL
        WHEN {_FOLDER.format(p="path")} = {_FOLDER.format(p="wanted")} THEN CASE WHEN lower(path) <> lower(wanted) THEN 2 END WHEN {_FOLDER.format(p="path")} = concat({_FOLDER.format(p="wanted")}, 'Processed/') THEN 3 END AS tier
        FROM kw JOIN kl ON kw.root = kl.root AND kw.base = kl.base), t AS (SELECT *, min(tier) OVER (PARTITION BY job_id) AS best FROM u WHERE tier IS NOT NULL)
    SELECT DISTINCT job_id, path, tier FROM t WHERE tier = best"""
NAMED_DUCKDB = f"{_FILES}, ln AS (SELECT path, dir, file, unnest(list_distinct([{_NAMES.replace('matches_', 'regexp_matches')}])) AS base FROM lf)"
_TIERS = f"""o AS (SELECT job_id, original_path, {_DIR} AS dir, lower({_BASE}) AS base FROM f), i AS (SELECT * FROM ln WHERE matches_(file, '[.](tif|tiff|jpg|jpeg|png)$')),
        d AS (SELECT job_id, i.path, 2 AS tier FROM o JOIN i ON o.dir = i.dir AND o.base = i.base WHERE lower(i.path) <> lower(o.original_path)), q AS (SELECT job_id, i.path, 3 AS tier FROM o JOIN i ON concat(o.dir, 'Processed/') = i.dir AND o.base = i.base),
        g AS (SELECT job_id, original_path AS path, 4 AS tier FROM o JOIN listing l ON o.original_path = l.path),
        u AS (SELECT * FROM r UNION ALL SELECT * FROM d UNION ALL SELECT * FROM q UNION ALL SELECT * FROM g), t AS (SELECT *, min(tier) OVER (PARTITION BY job_id) AS best FROM u)
        SELECT DISTINCT job_id, path, tier FROM t WHERE tier = best"""



def _held(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _numbers_of(text: Column) -> Column:
    """The numbers between commas, empty entries left out; null if one is none."""
    values = F.transform(F.filter(F.split(text, ","), lambda v: v != ""), lambda v: F.trim(v).try_cast("double"))
    return _held(values, lambda n: F.when(F.forall(n, lambda v: v.isNotNull()), n))


def parse_curve(text: Column) -> Column:
    """top and bottom (arrays of x, y) of a stored curve, "top:x1,y1,...;bottom:..."; null if a number is none anywhere, or one of the two is missing, odd or empty. Of repeated labels the last good one counts, other labels count for nothing but bad numbers."""
    label = lambda p: F.struct(F.substring_index(p, ":", 1).alias("label"), _numbers_of(F.substring(p, F.instr(p, ":") + 1, F.length(p))).alias("n"))
    parts = F.transform(F.filter(F.split(text, ";"), lambda p: F.instr(p, ":") > 0), label)
    point = lambda n, i: F.struct(F.get(n, i).alias("x"), F.get(n, i + 1).alias("y"))
    points = lambda n: F.transform(F.sequence(F.lit(0), F.size(n) - 2, F.lit(2)), lambda i: point(n, i))
    last = lambda p, name: F.try_element_at(F.filter(p, lambda q: (q["label"] == name) & (F.size(q["n"]) > 0) & (F.size(q["n"]) % 2 == 0)), F.lit(-1))["n"]
    made = lambda s: F.when(s["top"].isNotNull() & s["bottom"].isNotNull(), F.struct(points(s["top"]).alias("top"), points(s["bottom"]).alias("bottom")))
    sides = lambda p: F.when(F.forall(p, lambda q: q["n"].isNotNull()), F.struct(last(p, "top").alias("top"), last(p, "bottom").alias("bottom")))
    return _held(_held(parts, sides), made)


def format_curve(curve: Column) -> Column:
    """A curve as text again, one decimal."""
    points = lambda side: F.array_join(F.transform(curve[side], lambda q: F.format_string("%.1f,%.1f", q["x"], q["y"])), ",")
    return F.when(curve.isNotNull(), F.concat(F.lit("top:"), points("top"), F.lit(";bottom:"), points("bottom")))


def parse_calibration(text: Column) -> Column:
    """fx, fy, cx, cy, distortion (array), width and height of a stored calibration, "fx,fy,cx,cy;d1,...;w,h"; null unless it has three parts, four intrinsics and two whole sizes, and every number is one."""
    parts = F.split(text, ";")
    part = lambda i: F.split(F.get(parts, F.lit(i)), ",")
    doubles = lambda i: F.transform(part(i), lambda v: F.trim(v).try_cast("double"))
    sizes = F.transform(part(2), lambda v: F.trim(v).try_cast("int"))
    known = lambda a: F.forall(a, lambda v: v.isNotNull())
    fine = (F.size(parts) == 3) & (F.size(part(0)) == 4) & (F.size(part(2)) == 2) & known(doubles(0)) & known(doubles(1)) & known(sizes)
    intrinsics = [F.get(doubles(0), F.lit(i)).alias(n) for i, n in enumerate(("fx", "fy", "cx", "cy"))]
    return F.when(fine, F.struct(*intrinsics, doubles(1).alias("distortion"), F.get(sizes, F.lit(0)).alias("width"), F.get(sizes, F.lit(1)).alias("height")))


def format_calibration(c: Column) -> Column:
    """A calibration as text again; each number in the shortest form that gives it back."""
    joined = lambda values: F.array_join(F.transform(values, lambda v: v.cast("string")), ",")
    return F.when(c.isNotNull(), F.concat(joined(F.array(c["fx"], c["fy"], c["cx"], c["cy"])), F.lit(";"), joined(c["distortion"]), F.lit(";"), c["width"].cast("string"), F.lit(","), c["height"].cast("string")))


def sanitize_name(name: Column) -> Column:
    """A file name without what file systems refuse (<>:"/|?* and backslashes, and characters below the space), each turned into _; "untitled" if nothing is left."""
    clean = F.trim(F.regexp_replace(name, r'[<>:"/|?*\\\x00-\x1F]', "_"))
    return F.when(F.coalesce(clean, F.lit("")) == "", "untitled").otherwise(clean)


PLANS = {
    "b01_parse_frames": Plan(("batch",), "Frames of a batch; malformed entries are skipped.", f"WITH {FRAMES_SPARK} SELECT batch_id, n, x, y, w, h FROM ok", f"WITH {FRAMES_DUCKDB} SELECT batch_id, n, x, y, w, h FROM ok"),
    "b02_format_frames": Plan(("batch",), "Frames as text again, one decimal.",
        f"WITH {FRAMES_SPARK} SELECT batch_id, array_join(transform(array_sort(collect_list(struct(n, x, y, w, h))), t -> format_string('%.1f,%.1f,%.1f,%.1f', t.x, t.y, t.w, t.h)), ';') AS text FROM ok GROUP BY batch_id",
        f"WITH {FRAMES_DUCKDB} SELECT batch_id, string_agg(printf('%.1f,%.1f,%.1f,%.1f', x, y, w, h), ';' ORDER BY n) AS text FROM ok GROUP BY batch_id"),
    "b03_parse_crop": Plan(("capture_job",), "A stored crop as four corners of a 1000 x 800 image.", f"WITH {CROP_SPARK} SELECT job_id, kind, x1, y1, x2, y2, x3, y3, x4, y4 FROM crop", f"WITH {CROP_DUCKDB} SELECT job_id, kind, x1, y1, x2, y2, x3, y3, x4, y4 FROM crop"),
    "b04_format_corners": Plan(("capture_job",), "Corners as text, one decimal.", f"WITH {CROP_SPARK} SELECT job_id, format_string('%.1f,%.1f,%.1f,%.1f,%.1f,%.1f,%.1f,%.1f', x1, y1, x2, y2, x3, y3, x4, y4) AS text FROM crop", f"WITH {CROP_DUCKDB} SELECT job_id, printf('%.1f,%.1f,%.1f,%.1f,%.1f,%.1f,%.1f,%.1f', x1, y1, x2, y2, x3, y3, x4, y4) AS text FROM crop"),
    "b07_explode_frames": Plan(("batch",), "A row for each frame, with its suffix: at least two digits.", f"WITH {FRAMES_SPARK} SELECT batch_id, n, concat('_frame', lpad(CAST(n AS STRING), greatest(2, length(CAST(total AS STRING))), '0')) AS suffix FROM ok", f"WITH {FRAMES_DUCKDB} SELECT batch_id, n, concat('_frame', lpad(CAST(n AS STRING), CAST(greatest(2, length(CAST(total AS STRING))) AS INT), '0')) AS suffix FROM ok"),
    "b08_sanitize_name": Plan(("given_name",), "A file name without characters that file systems refuse; 'untitled' if nothing is left.", run=lambda given_name: given_name.select("id", sanitize_name(F.col("name")).alias("name")),
        duckdb=r"""SELECT id, CASE WHEN trim(t) = '' THEN 'untitled' ELSE trim(t) END AS name FROM (SELECT id, regexp_replace(name, '[<>:"/|?*\\\x00-\x1F]', '_', 'g') AS t FROM given_name) q"""),
    "b09_capture_name": Plan(("capture_job", "batch", "project"), "Name of a capture and path of its thumbnail; recaptures end in _R.",
        """SELECT j.job_id, concat(p.name, '_', b.batch_code, '_', lpad(CAST(j.page_number AS STRING), 6, '0'), CASE WHEN j.original_path LIKE '%!_R.jpg' ESCAPE '!' THEN '_R' ELSE '' END) AS name,
        concat(p.output_directory, '/', b.batch_code, '/Thumbnails/', lpad(CAST(j.page_number AS STRING), 6, '0'), '.png') AS thumbnail FROM capture_job j JOIN batch b ON j.batch_id = b.batch_id JOIN project p ON b.project_id = p.project_id"""),
    "b10_is_derivative": Plan(("capture_job", "listing"), "Files of the same folder that derive from a job's original: base name and a known suffix; recaptures of the page do not.",
        f"WITH {NAMED_SPARK}, j AS (SELECT DISTINCT original_path FROM capture_job), o AS (SELECT original_path, explode(array(concat(dir, base))) AS name FROM {_ORIGINALS.format(of='j')} p) SELECT o.original_path, l.path FROM (SELECT *, hash(name) AS place FROM o) o JOIN (SELECT *, hash(name) AS place FROM ln) l ON o.place = l.place AND o.name = l.name",
        f"WITH o AS (SELECT DISTINCT original_path, {_DIR} AS dir, lower({_BASE}) AS base FROM capture_job), {NAMED_DUCKDB} SELECT original_path, path FROM o JOIN ln ON o.dir = ln.dir AND o.base = ln.base"),
    "b11_resolve_outputs": Plan(("capture_job", "listing"), "Files to export of each final page; the first of these that there are: recorded outputs that exist, images that derive from the original beside it, those in Processed/, the original.",
        f"WITH {FINAL}, {NAMED_SPARK}, {RESOLVED_SPARK}",
        f"WITH {FINAL}, {NAMED_DUCKDB}, p AS (SELECT job_id, unnest(string_split(processed_path, ';')) AS path FROM f), r AS (SELECT job_id, p.path, 1 AS tier FROM p JOIN listing l ON p.path = l.path), {_TIERS.replace('matches_', 'regexp_matches')}"),
    "b12_decode_setting": Plan(("setting_reading", "setting_code"), "Name of a setting's code, from a table of codes (setting, code, name); unknown ones in hexadecimal.",
        "SELECT r.id, r.setting, r.code, coalesce(c.name, concat('0x', hex(r.code))) AS name FROM setting_reading r LEFT JOIN setting_code c ON r.setting = c.setting AND r.code = c.code",
        "SELECT r.id, r.setting, r.code, coalesce(c.name, concat('0x', printf('%X', r.code))) AS name FROM setting_reading r LEFT JOIN setting_code c ON r.setting = c.setting AND r.code = c.code"),
    "b05_parse_curve": Plan(("curve_text",), "Stored curves: both sides needed; an odd count or one bad number makes the whole value null. Points, the first and last of them, and the text that they give again.",
        run=lambda curve_text: curve_text.select("job_id", parse_curve(F.col("txt")).alias("c")).select("job_id", F.when(F.col("c").isNotNull(), F.size("c.top")).alias("top_points"), F.when(F.col("c").isNotNull(), F.size("c.bottom")).alias("bottom_points"), F.col("c.top")[0]["x"].alias("x0"), F.element_at("c.bottom", -1)["y"].alias("y1"), format_curve(F.col("c")).alias("text")),
        duckdb="""WITH p AS (SELECT job_id, string_split(regexp_extract(txt, 'top:([^;]*)', 1), ',') AS a, string_split(regexp_extract(txt, 'bottom:([^;]*)', 1), ',') AS b FROM curve_text), g AS (SELECT job_id, len(a) % 2 = 0 AND len(b) % 2 = 0 AND len(list_filter(a, lambda v: try_cast(v AS DOUBLE) IS NULL)) = 0 AND len(list_filter(b, lambda v: try_cast(v AS DOUBLE) IS NULL)) = 0 AS good, a, b FROM p)
        SELECT job_id, CASE WHEN good THEN len(a) // 2 END AS top_points, CASE WHEN good THEN len(b) // 2 END AS bottom_points, CASE WHEN good THEN try_cast(a[1] AS DOUBLE) END AS x0, CASE WHEN good THEN try_cast(b[len(b)] AS DOUBLE) END AS y1,
        CASE WHEN good THEN concat('top:', array_to_string(list_transform(a, lambda v: printf('%.1f', CAST(v AS DOUBLE))), ','), ';bottom:', array_to_string(list_transform(b, lambda v: printf('%.1f', CAST(v AS DOUBLE))), ',')) END AS text FROM g"""),
    "b06_parse_calibration": Plan(("calibration_text",), "Stored calibrations: three parts with four intrinsics, distortions and two sizes, else null. Its numbers, and whether the text that they give again is read as the same.",
        run=lambda calibration_text: calibration_text.select("calibration_id", parse_calibration(F.col("txt")).alias("c")).select("calibration_id", "c.fx", "c.fy", "c.cx", "c.cy", F.aggregate("c.distortion", F.lit(0.0), lambda a, v: a + v).alias("distortion_sum"), "c.width", "c.height", (parse_calibration(format_calibration(F.col("c"))) == F.col("c")).alias("again")),
        duckdb="""WITH p AS (SELECT calibration_id, string_split(txt, ';') AS s FROM calibration_text), q AS (SELECT calibration_id, len(s) AS parts, list_transform(string_split(s[1], ','), lambda v: try_cast(v AS DOUBLE)) AS i, list_transform(string_split(s[2], ','), lambda v: try_cast(v AS DOUBLE)) AS d, list_transform(string_split(s[3], ','), lambda v: try_cast(v AS INT)) AS z FROM p),
        g AS (SELECT *, coalesce(parts = 3 AND len(i) = 4 AND len(z) = 2 AND len(list_filter(i, lambda v: v IS NULL)) = 0 AND len(list_filter(d, lambda v: v IS NULL)) = 0 AND len(list_filter(z, lambda v: v IS NULL)) = 0, false) AS good FROM q)
        SELECT calibration_id, CASE WHEN good THEN i[1] END AS fx, CASE WHEN good THEN i[2] END AS fy, CASE WHEN good THEN i[3] END AS cx, CASE WHEN good THEN i[4] END AS cy, CASE WHEN good THEN list_reduce(d, lambda a, v: a + v, 0e0) END AS distortion_sum, CASE WHEN good THEN z[1] END AS width, CASE WHEN good THEN z[2] END AS height, CASE WHEN good THEN true END AS again FROM g"""),
}
