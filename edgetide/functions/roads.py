"""Access rules of roads: a way's tags, in order, to six access levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("foot", "car_forward", "car_backward", "bike_forward", "bike_backward", "train")
#: What each highway class says of foot, car and bike.
HIGHWAYS = {
    "cycleway": ("allowed", None, "track"),
    "path": ("allowed", None, "allowed"),
    "footway": ("allowed", None, "allowed"),
    "steps": ("allowed", None, "allowed"),
    "pedestrian": ("allowed", None, "allowed"),
    "primary": ("allowed", "primary", "allowed"),
    "primary_link": ("allowed", "primary", "allowed"),
    "secondary": ("allowed", "secondary", "allowed"),
    "secondary_link": ("allowed", "secondary", "allowed"),
    "tertiary": ("allowed", "tertiary", "allowed"),
    "tertiary_link": ("allowed", "tertiary", "allowed"),
    "unclassified": ("allowed", "residential", "allowed"),
    "residential": ("allowed", "residential", "allowed"),
    "living_street": ("allowed", "residential", "allowed"),
    "road": ("allowed", "residential", "allowed"),
    "service": ("allowed", "residential", "allowed"),
    "track": ("allowed", "residential", "allowed"),
    "motorway": ("forbidden", "motorway", "forbidden"),
    "motorway_link": ("forbidden", "motorway", "forbidden"),
    "motorway_junction": ("forbidden", "motorway", "forbidden"),
    "trunk": ("forbidden", "trunk", "forbidden"),
    "trunk_link": ("forbidden", "trunk", "forbidden"),
}
#: What a cycleway tag says, by direction; any other value is a lane forward.
CYCLEWAYS = {"track": ("track", None), "opposite_track": (None, "track"), "opposite": (None, "allowed"), "share_busway": ("busway", None), "lane_left": (None, "lane"), "opposite_lane": (None, "lane")}


def _case(value: Column, table: dict[str, str | None], default: str | None = None) -> Column:
    out = F.lit(None).cast("string")
    for k, v in reversed(list(table.items())):
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return F.when(value.isin(*table), out).otherwise(F.lit(default))


def access(tags: Column) -> Column:
    """A struct of MODES for tags given as an array of (key, value), later ones over earlier; a mode that no tag names is forbidden."""

    def step(acc: Column, tag: Column) -> Column:
        k, v = tag["key"], tag["value"]
        highway = [_case(v, {h: says[i] for h, says in HIGHWAYS.items()}) for i in range(3)]
        one_way = ((k == "oneway") & v.isin("yes", "true", "1")) | ((k == "junction") & (v == "roundabout"))
        against_bus = v.isin("opposite_lane", "opposite_track")
        says = {
            "foot": F.when(k == "highway", highway[0]).when(k.isin("pedestrian", "foot"), F.when(v == "no", "forbidden").otherwise("allowed")),
            "car_forward": F.when(k == "highway", highway[1]),
            "car_backward": F.when(one_way, "forbidden"),
            "bike_forward": F.when(k == "highway", highway[2]).when(k == "cycleway", _case(v, {c: d[0] for c, d in CYCLEWAYS.items()}, "lane")).when(k == "bicycle", F.when(v.isin("no", "false"), "forbidden").otherwise("allowed")).when((k == "busway") & ~against_bus, "busway"),
            "bike_backward": F.when(k == "cycleway", _case(v, {c: d[1] for c, d in CYCLEWAYS.items()})).when((k == "busway") & against_bus, "busway").when(one_way & acc["bike_backward"].isNull(), "forbidden"),
            "train": F.when(k == "railway", "allowed"),
        }
        return F.struct(*(F.coalesce(says[m], acc[m]).alias(m) for m in MODES))

    def settle(acc: Column) -> Column:
        done = {"car_backward": F.coalesce(acc["car_backward"], acc["car_forward"]), "bike_backward": F.coalesce(acc["bike_backward"], acc["bike_forward"])}
        return F.struct(*(F.coalesce(done.get(m, acc[m]), F.lit("forbidden")).alias(m) for m in MODES))

    return F.aggregate(tags, F.struct(*(F.lit(None).cast("string").alias(m) for m in MODES)), step, settle)


def accessible(levels: Column) -> Column:
    """Whether any mode is not forbidden."""
    out = levels[MODES[0]] != "forbidden"
    for m in MODES[1:]:
        out = out | (levels[m] != "forbidden")
    return out
