"""Healed lines: the edges of a chain in their order, as one polyline."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernel import wkb
from ..store import stored as written
from .components import ranked
from .graph import heal_candidates, heal_chains


def ordered(edges: DataFrame, line_edge: DataFrame) -> DataFrame:
    """(chain, seq, edge_id, forward, closed): the edges of each chain that healing makes one, from its beginning on.

    A chain runs the way its least edge does; a closed one begins with that edge.
    """
    pairs = written(heal_candidates(edges, line_edge), "heal_pairs")
    chains = written(heal_chains(edges, line_edge), "chains")
    ends = edges.select("edge_id", "start_node", "end_node")
    two = pairs.select("node_id", F.explode(F.array(F.struct(F.col("edge_1").alias("a"), F.col("edge_2").alias("b")), F.struct(F.col("edge_2").alias("a"), F.col("edge_1").alias("b")))).alias("p")).select("node_id", "p.*")
    came = ends.select(F.col("edge_id").alias("a"), F.col("end_node").alias("a_end"))
    goes = ends.select(F.col("edge_id").alias("b"), F.col("start_node").alias("b_start"))
    half = lambda edge, forward: F.col(edge) * 2 + F.when(forward, 0).otherwise(1)
    links = two.join(came, "a").join(goes, "b").select("a", half("a", F.col("a_end") == F.col("node_id")).alias("item"), half("b", F.col("b_start") == F.col("node_id")).alias("next"))
    edges_of = chains.groupBy("chain").agg(F.count("*").alias("n_edges"))
    links_of = links.join(chains.withColumnRenamed("edge_id", "a"), "a").groupBy("chain").agg(F.count("*").alias("n_links"))
    closed = edges_of.join(links_of, "chain", "left").select("chain", (F.coalesce("n_links", F.lit(0)) == 2 * F.col("n_edges")).alias("closed"))
    of = written(chains.join(closed, "chain"), "closed_chains")
    # A closed chain is cut before its least edge, in both directions.
    links = links.join(of.withColumnRenamed("edge_id", "a"), "a").where(~(F.col("closed") & ((F.col("next") == F.col("chain") * 2) | (F.col("item") == F.col("chain") * 2 + 1)))).select("item", "next")
    items = of.select("edge_id", "chain", "closed", F.explode(F.array(F.col("edge_id") * 2, F.col("edge_id") * 2 + 1)).alias("item"))
    rank = ranked(items.select("item").join(links, "item", "left"))
    placed = written(items.join(rank, "item"), "placed_halves")
    kept = placed.where(F.col("item") == F.col("chain") * 2).select("chain", "last")
    rows = placed.join(kept, ["chain", "last"])
    first = rows.groupBy("chain").agg(F.max("steps").alias("first"))
    return rows.join(first, "chain").select("chain", (F.col("first") - F.col("steps")).alias("seq"), "edge_id", (F.col("item") % 2 == 0).alias("forward"), "closed")


def healed_points(edges: DataFrame, line_edge: DataFrame) -> DataFrame:
    """(chain, seq, x, y, closed): the points of each healed line in order; ``edges`` with coordinates."""
    at = ordered(edges, line_edge).join(edges.select("edge_id", "x1", "y1", "x2", "y2"), "edge_id")
    way = lambda a, b: F.when(F.col("forward"), F.col(a)).otherwise(F.col(b))
    begin = F.struct(F.col("seq").alias("seq"), way("x1", "x2").alias("x"), way("y1", "y2").alias("y"))
    end = F.struct((F.col("seq") + 1).alias("seq"), way("x2", "x1").alias("x"), way("y2", "y1").alias("y"))
    return at.select("chain", "closed", F.explode(F.array(begin, end)).alias("p")).select("chain", "p.*", "closed").distinct()


def healed(edges: DataFrame, line_edge: DataFrame) -> DataFrame:
    """(chain, n_edges, closed, geometry): each healed line as a LineString in WKB."""
    points = healed_points(edges, line_edge).groupBy("chain", "closed").agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))).alias("points"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = [wkb.encode(("LINESTRING", [np.array([(p["x"], p["y"]) for p in ps], np.float64)])) for ps in b.column(2).to_pylist()]
            n = [len(ps) - 1 for ps in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), b.column(1), pa.array(lines, pa.binary())], names=["chain", "n_edges", "closed", "geometry"])

    return points.mapInArrow(run, "chain long, n_edges long, closed boolean, geometry binary")
