"""Raster tables ``(image_id, x, y, v)``: neighbourhoods, gradients, tiles, regions.

Neighbourhoods are built in two passes, along rows and along columns. A window then never holds more
than one line of one image, and an image is spread over as many tasks as it has lines.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import Key, join_stats, names, spread_by
from ..functions.scalars import angle_deg
from .histogram import histogram_array

IMAGE = "image_id"
# fixed values: the 3x3 Sobel kernel along x, by row; along y it is the transpose
SOBEL = ((-1, 0, 1), (-2, 0, 2), (-1, 0, 1))


def _line(key: Key, axis: str) -> Window:
    other = "y" if axis == "x" else "x"
    return Window.partitionBy(*names(key), other).orderBy(axis)


def _edge(shifted: Column, opposite: Column, centre: Column, edge: str) -> Column:
    if edge == "nearest":
        return F.coalesce(shifted, centre)
    if edge == "mirror":
        return F.coalesce(shifted, opposite)
    return shifted


def stencil(raster: DataFrame, value: Column, key: Key = IMAGE, edge: str = "none") -> DataFrame:
    """Add ``_n``: three rows (above, here, below) of three values (left, here, right).

    ``edge``: ``none`` leaves null outside, ``nearest`` repeats the border pixel, ``mirror`` reflects
    about it without repeating it.
    """
    across, down = _line(key, "x"), _line(key, "y")
    held = raster.withColumn("_v", value)
    left, right = F.lag("_v").over(across), F.lead("_v").over(across)
    centre = F.col("_v")
    rows = held.withColumn(
        "_row", F.array(_edge(left, right, centre, edge), centre, _edge(right, left, centre, edge))
    )
    up, low, here = F.lag("_row").over(down), F.lead("_row").over(down), F.col("_row")
    return rows.withColumn(
        "_n", F.array(_edge(up, low, here, edge), here, _edge(low, up, here, edge))
    ).drop("_v", "_row")


def _weighted(kernel, cell) -> Column:
    terms = [F.lit(float(w)) * cell(i, j) for i, row in enumerate(kernel) for j, w in enumerate(row) if w]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


TRANSPOSED = tuple(zip(*SOBEL))


def gradient_angles_sobel(raster: DataFrame, key: Key = IMAGE, value: str = "v") -> DataFrame:
    """Gradient direction per pixel in (0, 360]; pixels without a gradient are dropped."""
    near = stencil(raster, F.col(value).cast("double"), key, "mirror")
    cell = lambda i, j: F.col("_n")[i][j]
    parts = near.withColumns({"_gy": _weighted(TRANSPOSED, cell), "_gx": _weighted(SOBEL, cell)})
    return _directions(parts).drop("_n")


def _directions(parts: DataFrame) -> DataFrame:
    """Direction from the columns ``_gy`` and ``_gx``, which it consumes."""
    tiny = 1e-10
    moving = parts.where((F.abs("_gy") > tiny) | (F.abs("_gx") > tiny))
    return moving.withColumn("angle", angle_deg(F.col("_gy"), F.col("_gx"))).drop("_gy", "_gx")


def region_angles(raster: DataFrame, key: Key = IMAGE, value: str = "v", label: str = "label") -> DataFrame:
    """Sobel directions of every region on its own, all else set to zero.

    A pixel counts for each label found around it: the gradient of a region also lives on the ring of
    pixels just outside it.
    """
    near = stencil(raster, F.struct(F.col(value).cast("double").alias("v"), F.col(label).alias("l")), key, "mirror")
    labels = F.array_distinct(F.transform(F.flatten("_n"), lambda c: c["l"]))

    def gradients(label):
        cell = lambda i, j: F.when(F.col("_n")[i][j]["l"] == label, F.col("_n")[i][j]["v"]).otherwise(0.0)
        return F.struct(
            label.alias("label"), _weighted(TRANSPOSED, cell).alias("_gy"), _weighted(SOBEL, cell).alias("_gx")
        )

    # written out with their gradients, so that these are computed once per label
    spread = near.select(*names(key), "x", "y", F.inline(F.transform(labels, gradients)))
    return _directions(spread)


def angle_histogram(angles: DataFrame, bins: int = 120, key: Key = (IMAGE, "label")) -> DataFrame:
    """Mass of the directions in ``bins`` equal bins of [0, 360], one array per region."""
    return histogram_array(angles, "angle", 0.0, 360.0, bins, key)


def gaussian_line(size: int, sigma: float) -> tuple[list[float], list[float]]:
    """Normalised Gaussian weights and their central differences, both of length ``size``."""
    full = size + 2
    raw = [math.exp(-((i - (full - 1) / 2) ** 2) / (2 * sigma * sigma)) for i in range(full)]
    g = [v / sum(raw) for v in raw]
    return g[1:-1], [(g[i + 1] - g[i - 1]) / 2 for i in range(1, full - 1)]


def _convolve_line(value: str, weights: list[float], window: Window) -> Column:
    """Sum of w[i] * v(pos - i) along a line, the border pixel repeated outside."""
    half = len(weights) // 2

    def at(k: int) -> Column:
        # k steps back; short of the border fall back to the farthest pixel there is
        shift = F.lag if k > 0 else F.lead
        steps = [shift(value, s).over(window) for s in range(abs(k), 0, -1)]
        return F.coalesce(*steps, F.col(value))

    total = F.lit(0.0)
    for i, w in enumerate(weights):
        total = total + F.lit(w) * at(i - half)
    return total


def gradient_angles_gaussian(raster: DataFrame, size: int = 5, sigma: float = 1.0, key: Key = IMAGE, value: str = "v"):
    """Directions from derivatives of a Gaussian. The kernel is a product, so it runs line by line."""
    smooth, slope = gaussian_line(size, sigma)
    across, down = _line(key, "x"), _line(key, "y")
    base = raster.withColumn("_v", F.col(value).cast("double"))
    passed = base.withColumns(
        {"_s": _convolve_line("_v", smooth, across), "_d": _convolve_line("_v", slope, across)}
    )
    parts = passed.withColumns(
        {"_gy": _convolve_line("_s", slope, down), "_gx": _convolve_line("_d", smooth, down)}
    )
    return _directions(parts).drop("_v", "_s", "_d")


def boundary_pixels(labels: DataFrame, key: Key = IMAGE, label: str = "label") -> DataFrame:
    """255 where the Sobel response of the label map is nonzero on either axis, else 0."""
    near = stencil(labels, F.col(label).cast("double"), key, "nearest")
    cell = lambda i, j: F.col("_n")[i][j]
    edge = (_weighted(SOBEL, cell) != 0) | (_weighted(TRANSPOSED, cell) != 0)
    return near.withColumn("boundary", F.when(edge, 255).otherwise(0)).drop("_n")


def grid_neighbors(raster: DataFrame, connectivity: int = 8, key: Key = IMAGE, value: str = "v") -> DataFrame:
    """Pixel pairs ``(x, y, v, nx, ny, nv)`` among the 4 or 8 pixels around each."""
    near = stencil(raster, F.col(value), key)
    around = [
        (i, j) for i in range(3) for j in range(3) if (i, j) != (1, 1) and (connectivity == 8 or 1 in (i, j))
    ]
    cells = F.array(
        *[
            F.struct((F.col("x") + (j - 1)).alias("nx"), (F.col("y") + (i - 1)).alias("ny"), F.col("_n")[i][j].alias("nv"))
            for i, j in around
        ]
    )
    return (
        near.select(*names(key), "x", "y", F.col(value).alias("v"), F.explode(cells).alias("_c"))
        .select(*names(key), "x", "y", "v", "_c.*")
        .where(F.col("nv").isNotNull())
    )


def region_adjacency(labels: DataFrame, key: Key = IMAGE, label: str = "label") -> DataFrame:
    """Label pairs that touch, diagonals included."""
    near = stencil(labels, F.col(label), key)
    own = F.col(label)
    later = F.array(*[F.col("_n")[i][j] for i, j in ((1, 2), (2, 0), (2, 1), (2, 2))])
    other = F.explode(F.filter(later, lambda n: n.isNotNull() & (n != own)))
    return (
        near.select(*names(key), own.alias("_a"), other.alias("_b"))
        .select(*names(key), F.least("_a", "_b").alias("src"), F.greatest("_a", "_b").alias("dst"))
        .distinct()
    )


def crossing_number_nodes(skeleton: DataFrame, key: Key = IMAGE, value: str = "v") -> DataFrame:
    """Skeleton pixels with one or at least three 0-to-1 changes round their eight neighbours."""
    near = stencil(skeleton, F.when(F.col(value) != 0, 1).otherwise(0), key)
    ring = [(0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (1, 0), (0, 0)]
    cells = [F.col("_n")[i][j] for i, j in ring]
    changes = F.lit(0)
    for a, b in zip(cells, cells[1:] + cells[:1]):
        changes = changes + F.when((a == 0) & (b == 1), 1).when(a.isNotNull() & b.isNotNull(), 0)
    return (
        near.withColumn("crossings", changes)
        .where((F.col(value) != 0) & ((F.col("crossings") == 1) | (F.col("crossings") >= 3)))
        .drop("_n")
    )


def nonzero_pixels(raster: DataFrame, key: Key = IMAGE, value: str = "v") -> DataFrame:
    return raster.where(F.col(value) != 0).select(*names(key), "x", "y").distinct()


def image_sizes(raster: DataFrame, key: Key = IMAGE) -> DataFrame:
    return raster.groupBy(*names(key)).agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"))


def bilinear_resample(raster: DataFrame, height: int, width: int, key: Key = IMAGE, value: str = "v") -> DataFrame:
    """Resize by interpolation between four pixels.

    Each source pixel sends its share to the few output pixels whose position lies less than one
    pixel from it, and the shares combine before the exchange; there is no join per corner.
    """
    by = names(key)
    sized = join_stats(raster, image_sizes(raster, key), by)
    last = {"x": (F.col("_w") - 1, width), "y": (F.col("_h") - 1, height)}
    for axis, (span, n) in last.items():
        ratio = (span / F.lit(float(n - 1))) if n > 1 else F.lit(0.0)
        at = F.col(axis)
        low = F.when(ratio > 0, F.greatest(F.ceil(F.try_divide(at - 1, ratio)), F.lit(0))).otherwise(F.lit(0))
        high = F.when(ratio > 0, F.least(F.floor(F.try_divide(at + 1, ratio)), F.lit(n - 1))).otherwise(F.lit(n - 1))
        sized = (
            sized.withColumn(f"_o{axis}", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
            .withColumn(f"_t{axis}", 1.0 - F.abs(ratio * F.col(f"_o{axis}") - at))
            .where(F.col(f"_t{axis}") > 0)
        )
    return sized.groupBy(*by, F.col("_ox").alias("x"), F.col("_oy").alias("y")).agg(
        F.sum(F.col(value) * F.col("_tx") * F.col("_ty")).alias(value)
    )


def _tile_name(x0: Column, y0: Column) -> Column:
    return F.concat_ws("_", x0.cast("string"), y0.cast("string"))


def tile_grid(raster: DataFrame, height: int, width: int, shift: int | Column = 0) -> DataFrame:
    """Tile origin and name ``{col}_{row}`` of every pixel; border tiles may be smaller."""
    moved = F.lit(shift) if isinstance(shift, int) else shift
    x0 = F.floor((F.col("x") - moved) / width) * width + moved
    y0 = F.floor((F.col("y") - moved) / height) * height + moved
    return raster.withColumns({"tile_x": x0, "tile_y": y0}).withColumn(
        "tile", _tile_name(F.col("tile_x"), F.col("tile_y"))
    )


def tile_grid_shifted(raster: DataFrame, height: int, width: int, key: Key = IMAGE) -> DataFrame:
    """Tiles of the image without a margin of an eighth of its height on every side."""
    sized = join_stats(raster, image_sizes(raster, key), names(key)).withColumn("_t", F.floor(F.col("_h") / 8))
    t = F.col("_t")
    inner = sized.where(
        (F.col("x") >= t) & (F.col("x") < F.col("_w") - t) & (F.col("y") >= t) & (F.col("y") < F.col("_h") - t)
    )
    return tile_grid(inner, height, width, t).drop("_w", "_h", "_t")


def _split_index(pos: Column, n: Column, parts: int) -> Column:
    """Part of ``pos`` when ``n`` positions are cut into ``parts``, the first n % parts one longer."""
    short = F.floor(n / parts)
    extra = n % parts
    cut = (short + 1) * extra
    return F.when(pos < cut, F.floor(pos / (short + 1))).otherwise(
        extra + F.floor(F.try_divide(pos - cut, short))
    ).cast("long")


def array_split_tiles(raster: DataFrame, n_rows: int, n_cols: int, key: Key = IMAGE) -> DataFrame:
    sized = join_stats(raster, image_sizes(raster, key), names(key))
    return sized.withColumn(
        "tile",
        _split_index(F.col("y"), F.col("_h"), n_rows) * n_cols + _split_index(F.col("x"), F.col("_w"), n_cols),
    ).drop("_w", "_h")


def random_tile_origins(
    raster: DataFrame, height: int, width: int, n: int, seed: int, exclude: DataFrame | None = None, key: Key = IMAGE
) -> DataFrame:
    """``n`` different tile origins per image, by the order of a seeded hash.

    Candidate rows are spread over tasks before the columns are written out, and each task keeps only
    its first ``n`` per image.
    """
    by = names(key)
    rows = image_sizes(raster, key).withColumn(
        "tile_y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_h") - height))
    )
    all_origins = rows.repartition(*by, "tile_y").withColumn(
        "tile_x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_w") - width))
    )
    cand = all_origins.select(*by, "tile_x", "tile_y")
    if exclude is not None:
        cand = cand.join(exclude, [*by, "tile_x", "tile_y"], "left_anti")
    parts = [F.lit(seed), *[F.col(c) for c in (*by, "tile_x", "tile_y")]]
    hashed = cand.withColumn("_h", F.md5(F.concat_ws("-", *[p.cast("string") for p in parts])))
    w = Window.partitionBy(*by).orderBy("_h", "tile_x", "tile_y")
    return hashed.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r", "_h")


def cut_tiles(raster: DataFrame, origins: DataFrame, height: int, width: int, key: Key = IMAGE) -> DataFrame:
    """Pixels of the tiles at ``origins``. The few origins of an image travel as one array."""
    by = names(key)
    packed = origins.groupBy(*by).agg(F.collect_list(F.struct("tile_x", "tile_y")).alias("_o"))
    x, y = F.col("x"), F.col("y")
    hit = F.filter(
        "_o",
        lambda o: (x >= o["tile_x"]) & (x < o["tile_x"] + width) & (y >= o["tile_y"]) & (y < o["tile_y"] + height),
    )
    return (
        join_stats(raster, packed, by)
        .withColumn("_t", F.explode(hit))
        .select(*raster.columns, "_t.tile_x", "_t.tile_y", _tile_name(F.col("_t.tile_x"), F.col("_t.tile_y")).alias("tile"))
    )


def square_segments(raster: DataFrame, size: int, key: Key = IMAGE) -> DataFrame:
    """Label of the square of each pixel, from 1, row by row; leftover pixels form narrower squares."""
    sized = join_stats(raster, image_sizes(raster, key), names(key))
    per_row = F.ceil(F.col("_w") / size)
    label = 1 + F.floor(F.col("y") / size) * per_row + F.floor(F.col("x") / size)
    return sized.withColumn("label", label.cast("long")).drop("_w", "_h")


def region_props(labelled: DataFrame, key: Key = IMAGE, value: str = "v") -> DataFrame:
    """Centroid, mean and largest value and equivalent diameter of every region."""
    return labelled.groupBy(*names(key), "label").agg(
        F.avg("x").alias("coord_x"),
        F.avg("y").alias("coord_y"),
        F.avg(value).alias("mean_intensity"),
        F.max(value).alias("intensity_max"),
        F.count(F.lit(1)).alias("area"),
        F.sqrt(4.0 * F.count(F.lit(1)) / F.pi()).alias("equivalent_diameter"),
    )


def mask_outside(labelled: DataFrame, label: int, value: str = "v") -> DataFrame:
    return labelled.withColumn(value, F.when(F.col("label") == label, F.col(value)).otherwise(F.lit(0.0)))


def sequence_complexity(df: DataFrame, order: list[str], symbol: str, key: Key) -> DataFrame:
    """Number of LZW codes of each group's symbol sequence, and its ratio to the length.

    The code is sequential by definition: each task streams its sorted groups batch by batch and
    keeps only the code table of the group at hand, so a long sequence needs no room for its rows.
    """
    by = names(key)
    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in by) + ", codes long, length long"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, table, prefix, codes, length = None, {}, None, 0, 0
        for frame in frames:
            done = []
            for *group, sym in frame[[*by, symbol]].itertuples(index=False, name=None):
                if group != current:
                    if current is not None:
                        done.append((*current, codes + 1, length))
                    current, table, prefix, codes, length = group, {}, None, 0, 0
                length += 1
                if prefix is None:
                    prefix = (None, sym)
                    continue
                # a phrase is known by the number of the entry that made it and its last symbol
                entry = table.get((prefix, sym))
                if entry is not None:
                    prefix = entry
                else:
                    table[(prefix, sym)] = len(table)
                    codes += 1
                    prefix = (None, sym)
            if done:
                yield pd.DataFrame(done, columns=[*by, "codes", "length"])
        if current is not None:
            yield pd.DataFrame([(*current, codes + 1, length)], columns=[*by, "codes", "length"])

    cols = list(dict.fromkeys([*by, *order, symbol]))
    return spread_by(df.select(*cols), by, *order).mapInPandas(run, schema).withColumn("ratio", F.col("codes") / F.col("length"))


def angular_edge_weights(
    regions: DataFrame, pairs: DataFrame, key: Key = IMAGE, alpha: str = "fixed", bins: int = 120
) -> DataFrame:
    """Edge weights of region pairs from the mass of directions inside the cone between them.

    ``regions`` carries ``label, coord_x, coord_y, equivalent_diameter, pdf``; ``pairs`` is
    ``(key, src, dst)``. Bins are known by their right edge. The cone is centred on the direction to
    the other region, with half-angle arctan(1/2), or by the mean diameter over the true distance.
    """
    by = names(key)
    mean_d = regions.groupBy(*by).agg(F.avg("equivalent_diameter").alias("_d"))
    side = join_stats(pairs.select(*by, "src", "dst"), mean_d, by)
    for end in ("src", "dst"):
        cols = regions.select(
            *by,
            F.col("label").alias(end),
            F.col("coord_x").alias(f"_x_{end}"),
            F.col("coord_y").alias(f"_y_{end}"),
            F.col("pdf").alias(f"_p_{end}"),
        )
        side = side.join(cols, [*by, end])
    dx, dy = F.col("_x_dst") - F.col("_x_src"), F.col("_y_dst") - F.col("_y_src")
    half = (
        F.lit(math.degrees(math.atan(0.5)))
        if alpha == "fixed"
        else F.degrees(F.atan(0.5 * F.col("_d") / F.sqrt(dx * dx + dy * dy)))
    )
    side = side.withColumns(
        {
            "_half": half,
            "_go": F.degrees(F.atan2(dy, dx)) + 180.0,
            "_back": F.degrees(F.atan2(-dy, -dx)) + 180.0,
        }
    )
    step = 360.0 / bins

    def mass(pdf: str, gamma: str) -> Column:
        g, a = F.col(gamma), F.col("_half")

        def inside(edge):
            # signed angle from the direction to the edge, in [-180, 180)
            off = F.pmod(edge - g + 180.0, F.lit(360.0)) - 180.0
            return (off >= -a) & (off < a)

        part = F.transform(pdf, lambda v, i: F.when(inside((i + 1) * step), v).otherwise(0.0))
        return F.aggregate(part, F.lit(0.0), lambda s, v: s + v)

    from ..functions.scalars import edge_weight_from_mass

    return side.select(
        *by,
        "src",
        "dst",
        mass("_p_dst", "_go").alias("mass_to_src"),
        mass("_p_src", "_back").alias("mass_to_dst"),
    ).withColumn("weight", edge_weight_from_mass(F.col("mass_to_src")) + edge_weight_from_mass(F.col("mass_to_dst")))
