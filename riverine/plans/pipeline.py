"""Ordered steps on a Network, with checkpoints and resumption."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..network import Network
from ..params import Parameters
from . import steps


@dataclass(frozen=True)
class Step:
    name: str
    func: Callable[[Network, Parameters], Network]
    checkpoint: bool = True


class Pipeline:
    def __init__(self, steps: list[Step]):
        names = [s.name for s in steps]
        if len(set(names)) < len(names):
            raise ValueError(f"step names repeat: {sorted({n for n in names if names.count(n) > 1})}")
        self.steps = steps

    def run(self, network: Network | None, params: Parameters | None = None, *, spark: SparkSession | None = None, folder: str | None = None, resume_after: str | None = None) -> Network:
        """Steps in order; with a folder each step's tables are written there and read again, which also cuts lineage.

        resume_after names a step whose tables are in the folder; the run goes
        on behind it.  It ends early when no pipe or river is left.
        """
        params, first = params or Parameters(), 0
        if resume_after is not None:
            names = [s.name for s in self.steps]
            if resume_after not in names:
                raise ValueError(f"no step {resume_after!r}")
            if folder is None or spark is None:
                raise ValueError("to resume, the folder and the session are needed")
            network, first = load(spark, f"{folder}/{resume_after}"), names.index(resume_after) + 1
        else:
            network = steps.shaped(network)
        places: dict[str, tuple[object, str]] = {}
        for step in self.steps[first:]:
            network = step.func(network, params)
            if not network.has_drains():
                return network
            if folder is not None and step.checkpoint:
                network = save(network, f"{folder}/{step.name}", places)
        return network


def save(network: Network, path: str, places: dict[str, tuple[object, str]] | None = None) -> Network:
    """Writes the tables as Parquet and returns the network that reads them.

    Tables of meta are written where they are new; `places` remembers where
    those of earlier steps lie.  A manifest names them all.
    """
    spark, places = network.nodes.sparkSession, {} if places is None else places
    for name in ("nodes", "edges", "subs"):
        if (df := getattr(network, name)) is not None:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
    manifest, meta = {}, dict(network.meta)
    for name, value in network.meta.items():
        if not isinstance(value, DataFrame):
            manifest[name] = {"value": value}
            continue
        if name not in places or places[name][0] is not value:
            at = f"{path}/meta/{name}"
            value.write.mode("overwrite").parquet(at)
            meta[name] = spark.read.parquet(at)
            places[name] = (meta[name], at)
        manifest[name] = {"table": places[name][1]}
    text = json.dumps({"crs": network.crs, "meta": manifest})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return replace(load(spark, path, subs=network.subs is not None, meta=meta), crs=network.crs)


def load(spark: SparkSession, path: str, subs: bool | None = None, meta: dict | None = None) -> Network:
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = lambda n: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}"))
    if not there("edges"):
        raise FileNotFoundError(f"no tables in {path}")
    has = there("subs") if subs is None else subs
    crs = "EPSG:32617"
    if meta is None:
        found = json.loads(spark.read.text(f"{path}/manifest").first()["value"]) if there("manifest") else {"crs": crs, "meta": {}}
        crs, meta = found["crs"], {k: spark.read.parquet(v["table"]) if "table" in v else v["value"] for k, v in found["meta"].items()}
    return Network(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/subs") if has else None, crs, meta)


#: All steps in their order; ids, geometries and both are set more than once.
STEPS = [
    Step("assign_ids", steps.assign_ids), Step("remove_unwanted", steps.remove_unwanted), Step("clean_streets", steps.clean_streets), Step("street_cover", steps.street_cover), Step("to_undirected", steps.to_undirected),
    Step("split_long", steps.split_long), Step("merge_short", steps.merge_short), Step("assign_ids_again", steps.assign_ids), Step("contributing_area", steps.contributing_area), Step("insert_ponds", steps.insert_ponds),
    Step("elevation", steps.elevation), Step("both_ways", steps.both_ways), Step("fix_geometries", steps.fix_geometries), Step("no_crossings", steps.no_crossings), Step("surface_slope", steps.surface_slope), Step("slope_cost", steps.slope_cost),
    Step("weights", steps.weights), Step("identify_outfalls", steps.identify_outfalls), Step("derive", steps.derive), Step("connect_components", steps.connect_components), Step("break_intake_cycles", steps.break_intake_cycles), Step("pipes", steps.pipes),
    Step("drops", steps.drops), Step("river_channels", steps.river_channels), Step("outfall_slope", steps.outfall_slope), Step("pond_outlets", steps.pond_outlets), Step("route_into_ponds", steps.route_into_ponds), Step("reroute_subs", steps.reroute_subs),
    Step("enclosed_gaps", steps.enclosed_gaps), Step("resize_pipes", steps.resize_pipes), Step("resize_orifices", steps.resize_orifices), Step("fix_geometries_again", steps.fix_geometries), Step("assign_ids_last", steps.assign_ids), Step("simplify", steps.simplify_network),
    Step("orphan_subs", steps.orphan_subs), Step("street_channels", steps.street_channels),
]
#: These only act on a network with ponds.
PONDS = ("insert_ponds", "break_intake_cycles", "pond_outlets", "route_into_ponds", "reroute_subs", "enclosed_gaps", "resize_pipes", "resize_orifices")
#: What a bare network leaves out.
BARE = ("connect_components", "drops", "simplify", "street_channels")


def build_pipeline(bare: bool = False, with_ponds: bool = False) -> Pipeline:
    return Pipeline([s for s in STEPS if not (bare and s.name in BARE) and (with_ponds or s.name not in PONDS)])
