"""Validation, bookkeeping and augmentation, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazeframe.operators import augment as A
from gazeframe.operators import validation as val
from gazeframe.plans import stand_ins as V
from gazeframe.plans.pixel_queries import border_ctes
from gazeframe.plans.registry import query
from gazeframe.schemas import THRESHOLD_CANDIDATES
from gazeframe.sources import tables

TINY, LARGE = 2.0, 3.0  # cut-offs that split the 8x8 targets


def draw_sql(salt: int, seed: int, *keys: str) -> str:
    """The deterministic draw of the library as SQL."""
    state = f"{1 + salt * 1299709 + seed * 15485863}::BIGINT"
    for key in keys:
        state = f"(({state}) * 48271 + ({key}) % 2147483647) % 2147483647"
    for _ in range(2):
        state = f"(({state}) * 48271 + 11) % 2147483647"
    return f"(({state}) / 2147483647e0)"


_BINNED = """
targeted AS (SELECT frame_id, sum(t)::BIGINT AS area FROM targets GROUP BY frame_id),
binned AS (SELECT frame_id, sqrt(4 * area / pi()) AS mask_diameter,
    CASE WHEN sqrt(4 * area / pi()) <= 2 THEN 'tiny' WHEN sqrt(4 * area / pi()) >= 3 THEN 'large' ELSE 'medium' END AS size_bin
  FROM targeted),
bins AS (SELECT size_bin, count(*) AS bin_count, (SELECT count(*) FROM binned) AS n,
    (SELECT count(DISTINCT size_bin) FROM binned) AS k, row_number() OVER (ORDER BY size_bin) - 1 AS bin_no
  FROM binned GROUP BY size_bin),
weighted AS (SELECT *, n / (k * bin_count) AS weight FROM binned JOIN bins USING (size_bin))"""
BINNED = (V.TARGETS_SQL, _BINNED)


def _binned(spark, sf_dir):
    masks = val.mask_diameter(V.labelled_maps(spark, sf_dir)).select("frame_id", "mask_diameter")
    return masks.withColumn("size_bin", val.size_bin(F.col("mask_diameter"), TINY, LARGE))


@query("frame_id:i mask_diameter:d", "SELECT * FROM binned", BINNED)
def mask_diameter(spark, sf_dir):
    return _binned(spark, sf_dir)


@query("frame_id:i size_bin:s", "SELECT * FROM binned", BINNED)
def size_bin(spark, sf_dir):
    return _binned(spark, sf_dir)


@query("frame_id:i size_bin:s weight:d", "SELECT * FROM weighted", BINNED)
def balanced_weights(spark, sf_dir):
    return val.balanced_weights(_binned(spark, sf_dir))


@query(
    "frame_id:i size_bin:s weight:d draws:i",
    f"""SELECT p.frame_id, p.size_bin, weight, coalesce(draws, 0) AS draws
        FROM (SELECT *, row_number() OVER (PARTITION BY size_bin ORDER BY frame_id) - 1 AS place FROM weighted) p
        LEFT JOIN (SELECT size_bin, place, count(*) AS draws FROM (
            SELECT b.size_bin, floor({draw_sql(2, 5, 'd')} * b.bin_count)::BIGINT AS place
            FROM (SELECT frame_id AS d FROM binned) q
            JOIN bins b ON b.bin_no = floor({draw_sql(1, 5, 'd')} * b.k)::BIGINT) r GROUP BY ALL) c
          ON c.size_bin = p.size_bin AND c.place = p.place""",
    BINNED,
)
def weighted_resample(spark, sf_dir):
    return val.weighted_resample(_binned(spark, sf_dir), seed=5, ident="frame_id")


@query(
    "stem:s rule:s",
    """SELECT * FROM (SELECT concat('f', frame_id) AS stem, CASE WHEN frame_id % 17 = 3 THEN 'size_mismatch'
           WHEN count(DISTINCT level) > 2 OR min(level) <> 0 THEN 'mask_not_binary' WHEN max(level) = 0 THEN 'mask_empty' END AS rule
         FROM (SELECT frame_id, CASE frame_id % 19 WHEN 4 THEN t + 5 WHEN 6 THEN t * (1 + i % 2) ELSE t END AS level FROM targets) l
         GROUP BY frame_id) r WHERE rule IS NOT NULL""",
    (V.TARGETS_SQL,),
)
def mask_violations(spark, sf_dir):
    frame = F.col("frame_id")
    level = lambda t, i: F.when(frame % 19 == 4, t + 5).when(frame % 19 == 6, t * (1 + i % 2)).otherwise(t)
    pairs = V.labelled_maps(spark, sf_dir).select(
        F.format_string("f%d", frame).alias("stem"), F.col("map_width").alias("width"), F.col("map_height").alias("height"),
        F.when(frame % 17 == 3, 9).otherwise(F.col("map_width")).alias("mask_width"), F.col("map_height").alias("mask_height"),
        F.transform("target", level).alias("mask_pixels"),
    )
    return tables.mask_violations(pairs)


_DRAW = f"({draw_sql(3, 5, 'frame_id')} + {draw_sql(4, 5, 'frame_id')} / 2147483647e0)"


@query(
    "frame_id:i weight:d draws:i",
    f"""SELECT frame_id, weight, coalesce(draws, 0) AS draws FROM sized LEFT JOIN (
          SELECT s.frame_id, count(*) AS draws FROM (SELECT least(floor({_DRAW} * total)::HUGEINT, total - 1) AS at FROM laid) p
          ASOF JOIN (SELECT * FROM laid WHERE q > 0) s ON p.at >= s.first GROUP BY s.frame_id) hits USING (frame_id)""",
    (
        *BINNED,
        f"""
sized AS (SELECT frame_id, area / 7e0 + (frame_id % 13) / 3e0 - CASE WHEN frame_id % 13 = 0 THEN area / 7e0 ELSE 0 END AS weight FROM targeted),
shares AS (SELECT frame_id, CASE WHEN weight > 0 THEN greatest(1e0, round_even(weight / (SELECT max(weight) FROM sized) * {val.SHARES}, 0)) ELSE 0 END::HUGEINT AS q
  FROM sized),
laid AS (SELECT *, sum(q) OVER (ORDER BY frame_id) - q AS first, sum(q) OVER () AS total FROM shares)""",
    ),
)
def weighted_draws(spark, sf_dir):
    area = F.size(F.filter("target", lambda t: t > 0)) / F.lit(7.0)
    frame = F.col("frame_id")
    uneven = area + (frame % 13) / F.lit(3.0) - F.when(frame % 13 == 0, area).otherwise(0)
    return val.weighted_draws(V.labelled_maps(spark, sf_dir).select("frame_id", uneven.alias("weight")), seed=5, ident="frame_id")


_SCORES = f"""
candidates AS (SELECT unnest([{", ".join(f"{t}::DOUBLE" for t in THRESHOLD_CANDIDATES)}]) AS threshold,
    unnest(range({len(THRESHOLD_CANDIDATES)})) AS candidate),
meets AS (SELECT frame_id, candidate, threshold, count(*) FILTER (p > threshold) AS predicted_area,
    count(*) FILTER (t > 0.5e0) AS target_area, count(*) FILTER (p > threshold AND t > 0.5e0) AS intersection
  FROM pixels JOIN targets USING (frame_id, i), candidates GROUP BY ALL),
scores AS (SELECT *, CASE WHEN predicted_area + target_area - intersection > 0
      THEN intersection / (predicted_area + target_area - intersection + 1e-6) ELSE 1 END AS iou,
    CASE WHEN predicted_area + target_area > 0 THEN 2e0 * intersection / (predicted_area + target_area + 1e-6) ELSE 1 END AS dice
  FROM meets)"""
_SHAPES = f"""
marked AS (SELECT frame_id, y, x FROM targets WHERE t > 0.5e0),
{border_ctes('marked')},
shapes AS (SELECT frame_id, CASE WHEN coalesce(border, 0) > 0 THEN 4 * pi() * area / (border * border) ELSE 0 END AS target_circularity
  FROM targeted LEFT JOIN borders USING (frame_id))"""
_REPORTS = """
rated AS (SELECT s.*, size_bin, target_circularity < 0.45e0 AS low FROM scores s JOIN binned USING (frame_id) JOIN shapes USING (frame_id)),
means AS (SELECT candidate, threshold, avg(iou) AS macro_iou, avg(dice) AS macro_dice,
    avg(iou) FILTER (size_bin = 'tiny') AS tiny_iou, avg(iou) FILTER (size_bin = 'medium') AS medium_iou,
    avg(iou) FILTER (size_bin = 'large') AS large_iou, avg(iou) FILTER (low) AS low_circularity_iou
  FROM rated GROUP BY ALL),
reports AS (SELECT *, list_avg(list_filter([tiny_iou, medium_iou, large_iou], lambda v: v IS NOT NULL)) AS balanced_iou FROM means)"""


@query(
    "frame_id:i predicted_area:i target_area:i intersection:i iou:d dice:d",
    "SELECT * FROM scores WHERE threshold = 0.7e0",
    (V.PIXELS_SQL, V.TARGETS_SQL, _SCORES),
)
def overlap_scores(spark, sf_dir):
    return val.overlap_scores(V.labelled_maps(spark, sf_dir), 0.7)


@query(
    "frame_id:i target_circularity:d low_circularity:b",
    "SELECT *, target_circularity < 0.45e0 AS low_circularity FROM shapes",
    (*BINNED, _SHAPES),
)
def low_circularity_targets(spark, sf_dir):
    return val.low_circularity_targets(V.labelled_maps(spark, sf_dir))


REPORT = (
    "candidate:i threshold:d macro_iou:d macro_dice:d balanced_iou:d tiny_iou:d medium_iou:d "
    "large_iou:d low_circularity_iou:d"
)
SWEEP = (V.PIXELS_SQL, *BINNED, _SCORES, _SHAPES, _REPORTS)


def _sweep(spark, sf_dir):
    return val.threshold_sweep(
        V.labelled_maps(spark, sf_dir), "frame_id", tiny_max=TINY, large_min=LARGE
    )


@query(REPORT, "SELECT * FROM reports", SWEEP)
def threshold_sweep(spark, sf_dir):
    return _sweep(spark, sf_dir)


@query(
    REPORT,
    """SELECT * FROM reports ORDER BY round(balanced_iou, 12) DESC, round(macro_iou, 12) DESC,
         round(abs(threshold - 0.7e0), 12), candidate LIMIT 1""",
    SWEEP,
)
def select_threshold(spark, sf_dir):
    return val.select_threshold(_sweep(spark, sf_dir))


@query(
    "validation_loss:d",
    """SELECT avg(greatest(z, 0) - z * t + ln(1 + exp(-abs(z)))) AS validation_loss
       FROM (SELECT (p - 0.5e0) * 8 AS z, t FROM pixels JOIN targets USING (frame_id, i)) q""",
    (V.PIXELS_SQL, V.TARGETS_SQL),
)
def validation_loss(spark, sf_dir):
    maps = V.labelled_maps(spark, sf_dir)
    return val.validation_loss(
        maps.withColumn("logit", F.transform("prob", lambda p: (p - 0.5) * 8)), []
    )


@query(
    "run_id:i best_epoch:i best_score:d stop_epoch:i stopped_early:b",
    """SELECT run_id, arg_max(best_epoch, epoch) AS best_epoch, max(best) AS best_score, max(epoch) AS stop_epoch,
         max(epoch - best_epoch) >= 40 AS stopped_early FROM replay WHERE epoch > 0 GROUP BY run_id""",
    (
        V.EPOCHS_SQL,
        """
replay AS (SELECT DISTINCT run_id, 0::BIGINT AS epoch, -1e300::DOUBLE AS best, 0::BIGINT AS best_epoch FROM epochs
  UNION ALL SELECT r.run_id, e.epoch, CASE WHEN e.balanced_iou > r.best + 1e-4 THEN e.balanced_iou ELSE r.best END,
    CASE WHEN e.balanced_iou > r.best + 1e-4 THEN e.epoch ELSE r.best_epoch END
  FROM replay r JOIN epochs e ON e.run_id = r.run_id AND e.epoch = r.epoch + 1 WHERE r.epoch - r.best_epoch < 40)""",
    ),
)
def early_stop_replay(spark, sf_dir):
    return val.early_stop_replay(V.epochs(spark, sf_dir))


@query(
    "p_partkey:i run_name:s name_allowed:b learning_rate:d meets_promotion_target:b written_iou:d keeps_nulls:b",
    """SELECT p_partkey, balanced_iou AS written_iou, TRUE AS keeps_nulls, name AS run_name, regexp_matches(name, '^[A-Za-z0-9][A-Za-z0-9._-]*$') AS name_allowed,
         learning_rate, balanced_iou >= 0.85e0 AS meets_promotion_target
       FROM (SELECT *, coalesce(run_name, concat(CASE WHEN finetuned THEN 'ft' ELSE 'scratch' END,
               CASE WHEN balanced THEN '_bal' ELSE '_natural' END, '_lr',
               replace(replace(replace(printf('%.0e', learning_rate), 'e-0', 'e-'), 'e+0', 'e'), 'e+', 'e'), '_s', seed)) AS name
             FROM (SELECT *, CASE WHEN finetuned THEN finetune_learning_rate ELSE scratch_learning_rate END AS learning_rate
                   FROM runs) a) b""",
    (V.RUNS_SQL,),
)
def run_registry(spark, sf_dir):
    named = val.run_registry(V.runs(spark, sf_dir))
    return named.withColumns(
        {
            "written_iou": F.get_json_object("metadata", "$.balanced_iou").cast("double"),
            "keeps_nulls": F.col("metadata").contains('"size_iou":null,"low_circularity_iou":null'),
        }
    )


@query(
    "p_partkey:i rule:s",
    """SELECT p_partkey, unnest(list_filter([
         CASE WHEN p_size % 9 - 1 <= 0 THEN 'batch_size' END, CASE WHEN finetune_learning_rate - 1e-4 <= 0 THEN 'finetune_learning_rate' END,
         CASE WHEN p_size % 7 - 2 < 0 THEN 'min_improvement' END, CASE WHEN p_size % 4 = 0 OR p_size > 32 THEN 'threshold_candidates' END,
         CASE WHEN p_size >= 30 THEN 'tiny_max_diameter' END, CASE WHEN p_size / 40e0 > 1 THEN 'promotion_target_iou' END,
         CASE WHEN run_name IS NOT NULL AND NOT regexp_matches(run_name, '^[A-Za-z0-9][A-Za-z0-9._-]*$') THEN 'run_name' END],
         lambda v: v IS NOT NULL)) AS rule
       FROM (SELECT r.*, p.p_size FROM runs r JOIN part p USING (p_partkey)) s""",
    (V.RUNS_SQL,),
)
def config_violations(spark, sf_dir):
    size = F.col("seed")
    configs = V.runs(spark, sf_dir).select(
        "p_partkey",
        (size % 9 - 1).alias("batch_size"),
        (F.col("finetune_learning_rate") - 1e-4).alias("finetune_learning_rate"),
        (size % 7 - 2).alias("min_improvement"),
        F.when(size % 4 == 0, F.array().cast("array<double>")).otherwise(F.array(F.lit(0.5), size / 33.0)).alias("threshold_candidates"),
        size.alias("tiny_max_diameter"),
        F.lit(30).alias("large_min_diameter"),
        (size / 40.0).alias("promotion_target_iou"),
        "run_name",
    )
    return val.config_violations(configs, "p_partkey")


# --- augmentation -----------------------------------------------------------------------

SEED = 3


def _u(name: str) -> str:
    return draw_sql(A.SALTS[name], SEED, "frame_id", "0")


def _integer(name: str, top: str) -> str:
    return f"floor({_u(name)} * (({top}) + 1))::BIGINT"


_PAIRS = """
pairs AS (SELECT frame_id, g.i, g.x, g.y, g.g AS image, t.t * 255 AS mask FROM grey g JOIN targets t USING (frame_id, i)),
ids AS (SELECT DISTINCT frame_id FROM pairs),
cells AS (SELECT frame_id, i, i % 8 AS x, i // 8 AS y FROM ids, (SELECT unnest(range(64)) AS i) c)"""
PAIRS = (V.GREY_SQL, V.TARGETS_SQL, _PAIRS)
PIXEL_PAIR = "frame_id:i i:i image:i mask:i"


def _draws():
    return A.Draws(SEED, "frame_id")


def _flat(pairs):
    return pairs.select("frame_id", F.posexplode(F.arrays_zip("image", "mask")).alias("i", "v")).select(
        "frame_id", "i", "v.*"
    )


@query(
    PIXEL_PAIR,
    f"""SELECT c.frame_id, c.i, image, mask FROM cells c
        JOIN (SELECT frame_id, {_u('flip_h')} < 0.5e0 AS h, {_u('flip_v')} < 0.5e0 AS v FROM ids) d USING (frame_id)
        JOIN pairs p ON p.frame_id = c.frame_id AND p.x = CASE WHEN h THEN 7 - c.x ELSE c.x END
          AND p.y = CASE WHEN v THEN 7 - c.y ELSE c.y END""",
    PAIRS,
)
def augment_flip(spark, sf_dir):
    return _flat(A.augment_flip(V.grey(spark, sf_dir), 8, _draws(), chance=0.5))


@query(
    PIXEL_PAIR,
    """SELECT c.frame_id, c.i, coalesce(image, 0) AS image, coalesce(mask, 0) AS mask FROM cells c
       JOIN crops d USING (frame_id)
       LEFT JOIN pairs p ON p.frame_id = c.frame_id AND p.x = c.x + CASE WHEN on_ THEN dx ELSE 0 END
         AND p.y = c.y + CASE WHEN on_ THEN dy ELSE 0 END""",
    (
        *PAIRS,
        f"""
pads AS (SELECT frame_id, {_u('pad')} < 0.6e0 AS on_, {_integer('pad_left', '3')} AS l, {_integer('pad_right', '3')} AS r,
    {_integer('pad_top', '3')} AS t, {_integer('pad_bottom', '3')} AS b FROM ids),
crops AS (SELECT frame_id, on_, {_integer('crop_left', 'l + r')} - l AS dx, {_integer('crop_top', 't + b')} - t AS dy FROM pads)""",
    ),
)
def augment_pad_crop(spark, sf_dir):
    return _flat(A.augment_pad_crop(V.grey(spark, sf_dir), 8, _draws(), max_pad=3, chance=0.6))


_ZOOM = f"""
zooms AS (SELECT frame_id, n, CASE WHEN n > 8 THEN 1 ELSE -1 END * {_integer('zoom_left', 'abs(n - 8)')} AS dx,
    CASE WHEN n > 8 THEN 1 ELSE -1 END * {_integer('zoom_top', 'abs(n - 8)')} AS dy
  FROM (SELECT frame_id, CASE WHEN {_u('zoom')} < 0.7e0 THEN greatest(1, round_even(8 * (0.7e0 + (1.4e0 - 0.7e0) * {_u('zoom_scale')}), 0))::BIGINT
          ELSE 8 END AS n FROM ids) a),
taps AS (SELECT frame_id, o, s, greatest(0, 1 - abs((s + 0.5e0 - (o + 0.5e0) * (8 / n)) / greatest(8 / n, 1))) AS w
  FROM (SELECT frame_id, n, unnest(range(n)) AS o FROM zooms) a, (SELECT unnest(range(8)) AS s) b),
wide AS (SELECT p.frame_id, o AS xo, y, floor(round(sum(image * w) / sum(w), 6) + 0.5e0) AS v
  FROM pairs p JOIN taps t ON t.frame_id = p.frame_id AND t.s = p.x GROUP BY ALL),
grown AS (SELECT p.frame_id, xo, o AS yo, floor(round(sum(v * w) / sum(w), 6) + 0.5e0)::BIGINT AS image
  FROM wide p JOIN taps t ON t.frame_id = p.frame_id AND t.s = p.y GROUP BY ALL)"""


@query(
    PIXEL_PAIR,
    """SELECT c.frame_id, c.i, coalesce(g.image, 0) AS image, coalesce(p.mask, 0) AS mask FROM cells c JOIN zooms z USING (frame_id)
       LEFT JOIN grown g ON g.frame_id = c.frame_id AND g.xo = c.x + dx AND g.yo = c.y + dy
       LEFT JOIN pairs p ON p.frame_id = c.frame_id AND g.xo IS NOT NULL
         AND p.x = floor((c.x + dx + 0.5e0) * 8 / n) AND p.y = floor((c.y + dy + 0.5e0) * 8 / n)""",
    (*PAIRS, _ZOOM),
)
def augment_zoom(spark, sf_dir):
    return _flat(A.augment_zoom(V.grey(spark, sf_dir), 8, _draws(), scales=(0.7, 1.4), chance=0.7))


def _affine_ctes(reach_x: str, reach_y: str, shear: str) -> str:
    """Affine sampling with largest shifts in pixels and a shear in degrees, given as SQL."""
    return f"""
turns AS (SELECT frame_id, {_u('affine')} < 0.7e0 AS on_, pi() / 180 * (-25 + 50 * {_u('angle')}) AS a, tan(pi() / 180 * ({shear})) AS k,
    0.8e0 + (1.2e0 - 0.8e0) * {_u('affine_scale')} AS s,
    round_even(-{reach_x} + 2 * {reach_x} * {_u('shift_x')}, 0) + 4 AS tx, round_even(-{reach_y} + 2 * {reach_y} * {_u('shift_y')}, 0) + 4 AS ty FROM ids),
back AS (SELECT c.*, on_, (cos(a) - k * sin(a)) / s * (x + 0.5e0 - tx) + (sin(a) + k * cos(a)) / s * (y + 0.5e0 - ty) + 4 AS u,
    -sin(a) / s * (x + 0.5e0 - tx) + cos(a) / s * (y + 0.5e0 - ty) + 4 AS v FROM cells c JOIN turns USING (frame_id)),
near AS (SELECT *, u >= 0 AND u < 8 AND v >= 0 AND v < 8 AS inside, u - 0.5e0 - floor(u - 0.5e0) AS fx,
    v - 0.5e0 - floor(v - 0.5e0) AS fy, least(7, greatest(0, floor(u - 0.5e0))) AS x0, least(7, greatest(0, floor(u + 0.5e0))) AS x1,
    least(7, greatest(0, floor(v - 0.5e0))) AS y0, least(7, greatest(0, floor(v + 0.5e0))) AS y1 FROM back)"""


_AFFINE_PIXELS = """SELECT n.frame_id, n.i, CASE WHEN NOT on_ THEN o.image WHEN inside THEN floor(round(
           (a.image * (1 - fx) + b.image * fx) * (1 - fy) + (c.image * (1 - fx) + d.image * fx) * fy, 6)) ELSE 0 END AS image,
         CASE WHEN NOT on_ THEN o.mask WHEN inside THEN m.mask ELSE 0 END AS mask
       FROM near n JOIN pairs o ON o.frame_id = n.frame_id AND o.i = n.i
       JOIN pairs a ON a.frame_id = n.frame_id AND a.x = x0 AND a.y = y0
       JOIN pairs b ON b.frame_id = n.frame_id AND b.x = x1 AND b.y = y0
       JOIN pairs c ON c.frame_id = n.frame_id AND c.x = x0 AND c.y = y1
       JOIN pairs d ON d.frame_id = n.frame_id AND d.x = x1 AND d.y = y1
       LEFT JOIN pairs m ON m.frame_id = n.frame_id AND m.x = floor(u) AND m.y = floor(v)"""


@query(
    PIXEL_PAIR,
    _AFFINE_PIXELS,
    (*PAIRS, _affine_ctes("0.25e0 * 8", "0.1e0 * 8", f"-10 + 30 * {_u('shear')}")),
)
def augment_affine_ranges(spark, sf_dir):
    """A shift of its own for each axis, and a shear drawn from a range."""
    moved = A.augment_affine(
        V.grey(spark, sf_dir), 8, _draws(), degrees=25.0, scales=(0.8, 1.2), translate=(0.25, 0.1), shear=(-10.0, 20.0), chance=0.7
    )
    return _flat(moved)


@query(PIXEL_PAIR, _AFFINE_PIXELS, (*PAIRS, _affine_ctes("0.8e0", "0.8e0", "0")))
def augment_affine(spark, sf_dir):
    return _flat(
        A.augment_affine(
            V.grey(spark, sf_dir), 8, _draws(), degrees=25.0, scales=(0.8, 1.2), translate=0.1, chance=0.7
        )
    )


_TONES = f"""
tones AS (SELECT frame_id, {_u('jitter')} < 0.6e0 AS on_, 0.8e0 + (1.2e0 - 0.8e0) * {_u('brightness')} AS bf,
    0.8e0 + (1.2e0 - 0.8e0) * {_u('contrast')} AS cf, {_u('jitter_order')} < 0.5e0 AS bright_first,
    {_u('blur')} < 0.6e0 AS soft, 0.1e0 + (2e0 - 0.1e0) * {_u('sigma')} AS sigma FROM ids),
first AS (SELECT p.frame_id, i, x, y, image, CASE WHEN bright_first THEN least(255, floor(round(image * bf, 6))) ELSE image END AS v
  FROM pairs p JOIN tones USING (frame_id)),
middles AS (SELECT frame_id, floor(avg(v) + 0.5e0) AS m FROM first GROUP BY frame_id),
second AS (SELECT f.*, least(255, greatest(0, floor(round(m + (v - m) * cf, 6)))) AS c
  FROM first f JOIN middles USING (frame_id) JOIN tones USING (frame_id)),
toned AS (SELECT frame_id, i, x, y, soft, sigma, CASE WHEN NOT on_ THEN image WHEN bright_first THEN c
    ELSE least(255, floor(round(c * bf, 6))) END AS v FROM second JOIN tones USING (frame_id)),
offsets AS (SELECT unnest(range(-2, 3)) AS d),
across AS (SELECT t.frame_id, t.x, t.y, sum(n.v * exp(-0.5e0 * pow(d / t.sigma, 2))) / sum(exp(-0.5e0 * pow(d / t.sigma, 2))) AS v
  FROM toned t, offsets, toned n WHERE n.frame_id = t.frame_id AND n.y = t.y AND n.x = 7 - abs(7 - abs(t.x + d)) GROUP BY ALL),
down AS (SELECT t.frame_id, t.x, t.y, sum(n.v * exp(-0.5e0 * pow(d / t.sigma, 2))) / sum(exp(-0.5e0 * pow(d / t.sigma, 2))) AS v
  FROM toned t, offsets, across n WHERE n.frame_id = t.frame_id AND n.x = t.x AND n.y = 7 - abs(7 - abs(t.y + d)) GROUP BY ALL)"""


@query(
    "frame_id:i i:i image:i",
    """SELECT t.frame_id, t.i, CASE WHEN soft THEN round_even(round(d.v, 6), 0) ELSE t.v END AS image
       FROM toned t JOIN down d ON d.frame_id = t.frame_id AND d.x = t.x AND d.y = t.y""",
    (*PAIRS, _TONES),
)
def augment_photometric(spark, sf_dir):
    return _flat(A.augment_photometric(V.grey(spark, sf_dir), 8, _draws(), chance=0.6))


# Every step of a training pair in turn, at a side of 12 and with the transforms' own chances and ranges; p0 to p5 are
# the pairs after each.
_SHOWN_AT_12 = """
wide_pixels AS (SELECT frame_id, i % 16 AS sx, i // 16 AS sy, g.g AS image, t.t AS mask FROM grey g JOIN targets t USING (frame_id, i)),
ids AS (SELECT DISTINCT frame_id FROM grey),
cells AS (SELECT frame_id, i, i % 12 AS x, i // 12 AS y FROM ids, (SELECT unnest(range(144)) AS i) c),
fit_x AS (SELECT xo, sx, greatest(0, 1 - abs((sx + 0.5e0 - (xo + 0.5e0) * (16 / 12)) / (16 / 12))) AS w
  FROM (SELECT unnest(range(12)) AS xo) a, (SELECT unnest(range(16)) AS sx) b),
fit_y AS (SELECT yo, sy, greatest(0, 1 - abs((sy + 0.5e0 - (yo + 0.5e0) * (4 / 3)) / (4 / 3))) AS w
  FROM (SELECT unnest(range(3)) AS yo) a, (SELECT unnest(range(4)) AS sy) b),
fit_wide AS (SELECT frame_id, xo, sy, floor(round(sum(image * w) / sum(w), 6) + 0.5e0) AS v FROM wide_pixels JOIN fit_x USING (sx) GROUP BY ALL),
fit_small AS (SELECT frame_id, xo, yo, floor(round(sum(v * w) / sum(w), 6) + 0.5e0) AS image FROM fit_wide JOIN fit_y USING (sy) GROUP BY ALL),
p0 AS (SELECT c.*, coalesce(s.image, 0) AS image, coalesce(m.mask, 0) AS mask FROM cells c
  LEFT JOIN fit_small s ON s.frame_id = c.frame_id AND s.xo = c.x AND s.yo = c.y - 4
  LEFT JOIN wide_pixels m ON m.frame_id = c.frame_id AND c.y BETWEEN 4 AND 6 AND m.sx = floor((c.x + 0.5e0) * 16 / 12)
    AND m.sy = floor((c.y - 4 + 0.5e0) * 4 / 3))"""

_ZOOMED_AT_12 = f"""
room AS (SELECT frame_id, CASE WHEN {_u('zoom')} < 0.2e0 THEN greatest(1, round_even(12 * (0.85e0 + (1.15e0 - 0.85e0) * {_u('zoom_scale')}), 0))::BIGINT
    ELSE 12 END AS n FROM ids),
placed AS (SELECT frame_id, n, CASE WHEN n > 12 THEN 1 ELSE -1 END * {_integer('zoom_left', 'abs(n - 12)')} AS dx,
    CASE WHEN n > 12 THEN 1 ELSE -1 END * {_integer('zoom_top', 'abs(n - 12)')} AS dy FROM room),
zoom_taps AS (SELECT frame_id, o, s, greatest(0, 1 - abs((s + 0.5e0 - (o + 0.5e0) * (12 / n)) / greatest(12 / n, 1))) AS w
  FROM (SELECT frame_id, n, unnest(range(n)) AS o FROM room) a, (SELECT unnest(range(12)) AS s) b),
zoom_wide AS (SELECT p.frame_id, o AS xo, y, floor(round(sum(image * w) / sum(w), 6) + 0.5e0) AS v
  FROM p0 p JOIN zoom_taps t ON t.frame_id = p.frame_id AND t.s = p.x GROUP BY ALL),
zoom_grown AS (SELECT p.frame_id, xo, o AS yo, floor(round(sum(v * w) / sum(w), 6) + 0.5e0) AS image
  FROM zoom_wide p JOIN zoom_taps t ON t.frame_id = p.frame_id AND t.s = p.y GROUP BY ALL),
p1 AS (SELECT c.*, coalesce(g.image, 0) AS image, coalesce(p.mask, 0) AS mask FROM cells c JOIN placed z USING (frame_id)
  LEFT JOIN zoom_grown g ON g.frame_id = c.frame_id AND g.xo = c.x + dx AND g.yo = c.y + dy
  LEFT JOIN p0 p ON p.frame_id = c.frame_id AND g.xo IS NOT NULL
    AND p.x = floor((c.x + dx + 0.5e0) * 12 / n) AND p.y = floor((c.y + dy + 0.5e0) * 12 / n))"""

_MOVED_AT_12 = f"""
margins AS (SELECT frame_id, {_u('pad')} < 0.2e0 AS on_, {_integer('pad_left', '3')} AS l, {_integer('pad_right', '3')} AS r,
    {_integer('pad_top', '3')} AS t, {_integer('pad_bottom', '3')} AS b FROM ids),
shifts AS (SELECT frame_id, CASE WHEN on_ THEN {_integer('crop_left', 'l + r')} - l ELSE 0 END AS dx,
    CASE WHEN on_ THEN {_integer('crop_top', 't + b')} - t ELSE 0 END AS dy FROM margins),
p2 AS (SELECT c.*, coalesce(image, 0) AS image, coalesce(mask, 0) AS mask FROM cells c JOIN shifts USING (frame_id)
  LEFT JOIN p1 p ON p.frame_id = c.frame_id AND p.x = c.x + dx AND p.y = c.y + dy),
p3 AS (SELECT c.*, image, mask FROM cells c JOIN (SELECT frame_id, {_u('flip_h')} < 0.2e0 AS h, {_u('flip_v')} < 0.2e0 AS v FROM ids) d USING (frame_id)
  JOIN p2 p ON p.frame_id = c.frame_id AND p.x = CASE WHEN h THEN 11 - c.x ELSE c.x END AND p.y = CASE WHEN v THEN 11 - c.y ELSE c.y END),
angles AS (SELECT frame_id, {_u('affine')} < 0.2e0 AS on_, pi() / 180 * (-15 + 30 * {_u('angle')}) AS a,
    0.95e0 + (1.05e0 - 0.95e0) * {_u('affine_scale')} AS s FROM ids),
looked AS (SELECT c.*, on_, cos(a) / s * (x - 5.5e0) + sin(a) / s * (y - 5.5e0) + 6 AS u,
    -sin(a) / s * (x - 5.5e0) + cos(a) / s * (y - 5.5e0) + 6 AS v FROM cells c JOIN angles USING (frame_id)),
corners AS (SELECT *, u >= 0 AND u < 12 AND v >= 0 AND v < 12 AS inside, u - 0.5e0 - floor(u - 0.5e0) AS fx, v - 0.5e0 - floor(v - 0.5e0) AS fy,
    least(11, greatest(0, floor(u - 0.5e0))) AS x0, least(11, greatest(0, floor(u + 0.5e0))) AS x1,
    least(11, greatest(0, floor(v - 0.5e0))) AS y0, least(11, greatest(0, floor(v + 0.5e0))) AS y1 FROM looked),
p4 AS (SELECT n.frame_id, n.i, n.x, n.y, CASE WHEN NOT on_ THEN o.image WHEN inside THEN floor(round(
    (a.image * (1 - fx) + b.image * fx) * (1 - fy) + (c.image * (1 - fx) + d.image * fx) * fy, 6)) ELSE 0 END AS image,
    CASE WHEN NOT on_ THEN o.mask WHEN inside THEN m.mask ELSE 0 END AS mask
  FROM corners n JOIN p3 o ON o.frame_id = n.frame_id AND o.i = n.i
  JOIN p3 a ON a.frame_id = n.frame_id AND a.x = x0 AND a.y = y0 JOIN p3 b ON b.frame_id = n.frame_id AND b.x = x1 AND b.y = y0
  JOIN p3 c ON c.frame_id = n.frame_id AND c.x = x0 AND c.y = y1 JOIN p3 d ON d.frame_id = n.frame_id AND d.x = x1 AND d.y = y1
  LEFT JOIN p3 m ON m.frame_id = n.frame_id AND m.x = floor(u) AND m.y = floor(v))"""

_TONED_AT_12 = f"""
shades AS (SELECT frame_id, {_u('jitter')} < 0.2e0 AS on_, 0.8e0 + (1.2e0 - 0.8e0) * {_u('brightness')} AS bf,
    0.8e0 + (1.2e0 - 0.8e0) * {_u('contrast')} AS cf, {_u('jitter_order')} < 0.5e0 AS bright_first,
    {_u('blur')} < 0.2e0 AS soft, 0.1e0 + (2e0 - 0.1e0) * {_u('sigma')} AS sigma FROM ids),
lit AS (SELECT p.*, on_, bf, cf, bright_first, soft, sigma, CASE WHEN bright_first THEN least(255, floor(round(image * bf, 6))) ELSE image END AS v
  FROM p4 p JOIN shades USING (frame_id)),
levels AS (SELECT frame_id, floor(avg(v) + 0.5e0) AS m FROM lit GROUP BY frame_id),
steep AS (SELECT l.*, least(255, greatest(0, floor(round(m + (v - m) * cf, 6)))) AS c FROM lit l JOIN levels USING (frame_id)),
shaded AS (SELECT frame_id, i, x, y, mask, soft, sigma, CASE WHEN NOT on_ THEN image WHEN bright_first THEN c
    ELSE least(255, floor(round(c * bf, 6))) END AS v FROM steep),
reach AS (SELECT unnest(range(-2, 3)) AS d),
rows_soft AS (SELECT t.frame_id, t.i, t.x, t.y, sum(n.v * exp(-0.5e0 * pow(d / t.sigma, 2))) / sum(exp(-0.5e0 * pow(d / t.sigma, 2))) AS v
  FROM shaded t, reach, shaded n WHERE t.soft AND n.frame_id = t.frame_id AND n.y = t.y AND n.x = 11 - abs(11 - abs(t.x + d)) GROUP BY ALL),
both_soft AS (SELECT t.frame_id, t.i, sum(n.v * exp(-0.5e0 * pow(d / t.sigma, 2))) / sum(exp(-0.5e0 * pow(d / t.sigma, 2))) AS v
  FROM shaded t, reach, rows_soft n WHERE n.frame_id = t.frame_id AND n.x = t.x AND n.y = 11 - abs(11 - abs(t.y + d)) GROUP BY ALL),
p5 AS (SELECT t.frame_id, t.i, coalesce(round_even(round(b.v, 6), 0), t.v) AS image, mask FROM shaded t LEFT JOIN both_soft b USING (frame_id, i))"""


@query(
    "frame_id:i i:i image:d mask:i",
    "SELECT frame_id, i, image / 255 AS image, CASE WHEN mask > 0 THEN 1 ELSE 0 END AS mask FROM p5",
    (V.GREY_SQL, V.TARGETS_SQL, _SHOWN_AT_12, _ZOOMED_AT_12, _MOVED_AT_12, _TONED_AT_12),
)
def training_pairs(spark, sf_dir):
    pairs = V.grey(spark, sf_dir).select(
        "frame_id",
        F.col("image").alias("image_pixels"),
        F.lit(16).alias("image_width"),
        F.lit(4).alias("image_height"),
        F.col("mask").alias("mask_pixels"),
        F.lit(16).alias("mask_width"),
        F.lit(4).alias("mask_height"),
    )
    return _flat(A.training_pairs(pairs, "frame_id", seed=SEED, size=12, max_pad=3))
