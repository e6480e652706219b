"""Relations of extractions as a graph: typed edges, chains of any length, and what occurs together.

Edges are src, dst, rel (and id, the paper). All is joins and grouping; nothing is gathered in one place.

Rows: an edge with a null end is none; edges that repeat are one for each paper; a self-loop is an edge but no step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litforge.operators import sections

#: The types of relations, and the sections and fields that each is read from.
RELATIONS = (
    "microbe_disease_association",
    "intervention_affects_microbe",
    "microbe_produces_metabolite",
    "metabolite_affects_outcome",
    "microbe_microbe_interaction",
    "host_factor_modifies_relationship",
    "diversity_outcome_association",
)
#: Items of a group that meet in one row.
SLICE = 256


def _edge(rows: DataFrame, id_col: str, src: Column, dst: Column, rel: str) -> DataFrame:
    return rows.select(F.col(id_col).alias("id"), src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel"))


def relations(papers: DataFrame, json_col: str, id_col: str) -> DataFrame:
    """id, src, dst, rel: the edges of all seven types in extractions, and the steps of their pathways (pathway_step).
    The disease is the paper's; a microbe whose change is a treatment's effect is affected by the paper's intervention; a host
    factor points to each microbe that its entry names; an interaction counts both ways."""
    v = F.try_parse_json(json_col)
    about = lambda p: F.try_variant_get(v, p, "string")
    head = F.struct(F.col(id_col).alias(id_col), F.coalesce(about("$.disease.primary_disease"), about("$.primary_disease")).alias("disease"), about("$.intervention").alias("intervention"))
    of = lambda name: sections.section(papers, json_col, id_col, name)
    # a paper's disease and intervention go along with its entries: no join, of which a side could be broadcast
    microbes = sections.section(papers.select(head.alias("_paper"), json_col), json_col, "_paper", "microbe_relationships").select("_paper.*", "taxon_name", "change_context")
    treated = F.col("change_context") == "treatment_effect"
    made, bonds = of("metabolites"), of("microbe_interactions")
    pairs = F.explode(F.array(F.struct(F.col("microbe_1").alias("a"), F.col("microbe_2").alias("b")), F.struct(F.col("microbe_2").alias("a"), F.col("microbe_1").alias("b"))))
    factors = F.from_json(F.coalesce(F.to_json(F.try_variant_get(v, "$.host_factors", "array<variant>")), F.lit("[]")), "array<struct<factor:string,microbes:array<string>>>")
    host = papers.select(id_col, F.explode(factors).alias("h")).select(id_col, F.col("h.factor").alias("factor"), F.explode("h.microbes").alias("microbe"))
    step = of("mechanistic_pathways").select(id_col, F.transform("steps", lambda s: s["name"]).alias("names"))
    links = step.select(id_col, F.explode(F.zip_with(F.slice("names", 1, F.greatest(F.size("names") - 1, F.lit(0))), F.slice("names", 2, F.greatest(F.size("names") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("l"))
    found = [
        _edge(microbes.where(~F.coalesce(treated, F.lit(False))), id_col, F.col("taxon_name"), F.col("disease"), RELATIONS[0]),
        _edge(microbes.where(treated), id_col, F.col("intervention"), F.col("taxon_name"), RELATIONS[1]),
        _edge(made.select(id_col, "name", F.explode("produced_by").alias("by")), id_col, F.col("by"), F.col("name"), RELATIONS[2]),
        _edge(made, id_col, F.col("name"), F.col("associated_outcome"), RELATIONS[3]),
        _edge(bonds.select(id_col, pairs.alias("p")), id_col, F.col("p.a"), F.col("p.b"), RELATIONS[4]),
        _edge(host, id_col, F.col("factor"), F.col("microbe"), RELATIONS[5]),
        _edge(of("diversity_metrics"), id_col, F.col("metric_type"), F.col("associated_outcome"), RELATIONS[6]),
        _edge(links, id_col, F.col("l.a"), F.col("l.b"), "pathway_step"),
    ]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.where("src is not null and dst is not null").distinct()


def reached(edges: DataFrame, folder: str, starts: DataFrame | None = None, most: int = 1000) -> DataFrame:
    """src, dst, hops: all pairs of which edges lead from the one to the other, and the fewest edges between them, from all
    nodes or from those of starts (src). Each round goes one hop from the pairs that were new in the last one, so a cycle
    ends where nothing is new; rounds are tables under folder, which driver and executors share. The number of pairs may
    grow with the square of the nodes: that is the result. A fault after `most` rounds."""
    spark = edges.sparkSession
    hops = edges.select("src", "dst").where("src <> dst").distinct()
    new = (hops.join(starts.select("src").distinct().hint("merge"), "src", "left_semi") if starts is not None else hops).withColumn("hops", F.lit(1))
    seen = None
    for n in range(1, most + 1):
        new.write.mode("overwrite").parquet(f"{folder}/hop={n}")
        new = spark.read.schema(new.schema).parquet(f"{folder}/hop={n}")
        if not new.limit(1).count():
            break
        seen = new if seen is None else seen.unionByName(new)
        onward = new.select("src", F.col("dst").alias("via")).join(hops.select(F.col("src").alias("via"), "dst").hint("merge"), "via").select("src", "dst").where("src <> dst").distinct()
        new = onward.join(seen.select("src", "dst").hint("merge"), ["src", "dst"], "left_anti").withColumn("hops", F.lit(n + 1))
    else:
        raise RuntimeError(f"chains did not end in {most} rounds")
    return seen if seen is not None else new


def together(rows: DataFrame, group: str, item: str) -> DataFrame:
    """item_1 < item_2 and n, the number of groups that hold both. A group's items meet in one row; those of a group of more
    than SLICE items are cut by hash into slices, and each two slices meet in a row of their own, so that a large group
    spreads and an item is sent as often as its group has slices. The number of pairs of a group grows with its square: that
    is the result. The sizes of groups of more than SLICE items are broadcast."""
    own = rows.select(F.col(group).alias("g"), F.col(item).alias("i")).where("g is not null and i is not null").distinct()
    large = own.groupBy("g").agg(F.count("*").alias("size")).where(F.col("size") > SLICE).select("g", F.ceil(F.col("size") / SLICE).alias("k"))
    sliced = own.join(F.broadcast(large), "g", "left").withColumn("k", F.coalesce("k", F.lit(1).cast("long"))).withColumn("s", F.pmod(F.xxhash64("i"), "k"))
    met = sliced.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    cell = met.groupBy("g", F.least("s", "other").alias("a"), F.greatest("s", "other").alias("b")).agg(F.collect_list(F.struct("i", "s")).alias("items"))
    first = cell.select("a", "b", "items", F.explode("items").alias("x"))
    # of two slices only items of different ones meet, since those of one meet in its own row
    second = F.filter("items", lambda y: (F.col("x.i") < y["i"]) & ((F.col("a") == F.col("b")) | (F.col("x.s") != y["s"])))
    pairs = first.select(F.col("x.i").alias("item_1"), F.explode(second).alias("y"))
    return pairs.groupBy("item_1", F.col("y.i").alias("item_2")).agg(F.count("*").alias("n"))
