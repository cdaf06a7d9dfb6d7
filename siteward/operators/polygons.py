"""Points in many polygons: geometry as WKT text, edges by bands, and a tile index per polygon.

Polygons with holes and multipolygons follow the even-odd rule over all their rings.  A polygon is cut into bands of the
tile height; a point meets the polygons whose edges of its band span its tile, and then only that band's edges.  Both
joins are dealt by a salt, as one tile or one polygon may hold a third of all points.

Defined results: the border belongs to a polygon, that of a hole too; of several polygons the least id holds a point; a
point in none, and one with a missing or infinite coordinate, has a null region; an empty or null geometry holds nothing;
any other text is an error; a ring that is not closed is closed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteward.operators.spatial import placed
from siteward.sources.tables import checkpointed

SALTS, TILES, BORDER = 8, 256, 1e-9
_NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
_RING = rf"\s*{_NUMBER}\s+{_NUMBER}(?:\s*,\s*{_NUMBER}\s+{_NUMBER})*\s*"
_POLYGON = rf"\(\s*\({_RING}\)(?:\s*,\s*\({_RING}\))*\s*\)"
_WHOLE = rf"(?i)^\s*(?:POLYGON\s*(?:EMPTY|{_POLYGON})|MULTIPOLYGON\s*(?:EMPTY|\(\s*{_POLYGON}(?:\s*,\s*{_POLYGON})*\s*\)))\s*$"


def edges_of(polygons: DataFrame) -> DataFrame:
    """region, x1, y1, x2, y2: the edges of all rings of polygons (region, wkt)."""
    good = F.coalesce(F.rlike("wkt", F.lit(_WHOLE)), F.lit(True))
    text = F.when(good, F.col("wkt")).otherwise(F.raise_error(F.concat(F.lit("no polygon: "), F.substring("wkt", 1, 60))))
    rings = F.explode(F.regexp_extract_all(text, F.lit(r"\(([^()]+)\)"), F.lit(1)))
    point = lambda p: F.transform(F.split(F.trim(p), r"\s+"), lambda v: v.cast("double"))
    rows = polygons.select("region", rings.alias("r")).select("region", F.transform(F.split("r", ","), point).alias("p"))
    steps = F.explode(F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda i: F.struct(F.get("p", i).alias("a"), F.get("p", F.pmod(i + 1, F.size("p"))).alias("b"))))
    ends = rows.select("region", steps.alias("s")).select("region", *[F.col(f"s.{e}")[k].alias(f"{c}{n}") for e, n in (("a", 1), ("b", 2)) for k, c in enumerate("xy")])
    return ends.filter("x1 <> x2 OR y1 <> y2")


def region_of(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """cell, region, border (whether it lies on the region's border) of every point (cell, x, y)."""
    edges = checkpointed(edges_of(polygons))
    box = edges.agg(*[f(g(f"{c}1", f"{c}2")).alias(f"{c}{n}") for c in "xy" for n, f, g in (("low", F.min, F.least), ("high", F.max, F.greatest))]).collect()[0]
    kind = polygons.schema["region"].dataType
    none = points.select("cell")
    if box["xlow"] is None:
        return none.select("cell", F.lit(None).cast(kind).alias("region"), F.lit(None).cast("boolean").alias("border"))
    wide, high = (max((box[f"{c}high"] - box[f"{c}low"]) / TILES, 1e-9) for c in "xy")
    tx, ty = (lambda v: F.floor((v - box["xlow"]) / wide).cast("long")), (lambda v: F.floor((v - box["ylow"]) / high).cast("long"))
    # One band more on each side, as a border point's band is rounded like its edge's.
    bands = F.explode(F.sequence(ty(F.least("y1", "y2")) - 1, ty(F.greatest("y1", "y2")) + 1))
    banded = checkpointed(edges.select("*", bands.alias("ty")))
    spans = banded.groupBy("region", "ty").agg(F.min(F.least("x1", "x2")).alias("a"), F.max(F.greatest("x1", "x2")).alias("b"))
    tiles = spans.select("region", "ty", F.explode(F.sequence(tx(F.col("a")) - 1, tx(F.col("b")) + 1)).alias("tx"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    inside = points.filter(placed(points) & F.col("x").between(box["xlow"], box["xhigh"]) & F.col("y").between(box["ylow"], box["yhigh"]))
    p = inside.select("cell", "x", "y", tx(F.col("x")).alias("tx"), ty(F.col("y")).alias("ty"), F.pmod(F.xxhash64("cell"), F.lit(SALTS)).cast("int").alias("salt"))
    near = p.join(tiles.select("*", salts), ["tx", "ty", "salt"]).drop("tx")
    met = near.join(banded.select("*", salts), ["region", "ty", "salt"])
    x, y, x1, y1, x2, y2 = (F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2"))
    crosses = ((y1 > y) != (y2 > y)) & (x < F.try_divide((x2 - x1) * (y - y1), y2 - y1) + x1)
    on = (F.abs((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)) <= BORDER) & x.between(F.least(x1, x2), F.greatest(x1, x2)) & y.between(F.least(y1, y2), F.greatest(y1, y2))
    each = met.groupBy("cell", "region").agg((F.count_if(crosses) % 2 == 1).alias("odd"), (F.count_if(on) > 0).alias("border")).filter("odd OR border")
    held = each.groupBy("cell").agg(F.min(F.struct("region", "border")).alias("r")).select("cell", "r.region", "r.border")
    return none.join(held, "cell", "left")


def within_any(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """points that lie in a polygon or on its border."""
    held = region_of(points.select("cell", "x", "y"), polygons).filter("region IS NOT NULL").select("cell")
    return points.join(held, "cell", "left_semi")
