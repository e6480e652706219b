"""The sections of a full extraction as tables of their own, and checks and chains over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_QUANT = "quantitative_data map<string,string>"
#: The fields of each section.
SECTIONS = {
    "microbe_relationships": f"taxon_name string, domain string, taxonomic_level string, direction string, change_context string, sample_site string, temporal_context string, {_QUANT}, location_in_paper string, confidence string, notes string",
    "diversity_metrics": "metric_type string, value string, direction string, comparison string, sample_site string, p_value string, associated_outcome string, notes string",
    "metabolites": f"name string, metabolite_class string, direction string, produced_by array<string>, associated_outcome string, sample_type string, {_QUANT}, notes string",
    "immune_markers": f"name string, marker_type string, direction string, associated_microbes array<string>, sample_site string, {_QUANT}",
    "virus_associations": f"virus_name string, associated_microbes array<string>, relationship string, {_QUANT}, notes string",
    "microbe_interactions": f"microbe_1 string, microbe_2 string, interaction_type string, strength string, evidence string, {_QUANT}",
    "mechanistic_pathways": "description string, steps array<struct<entity_type string, name string, action string>>, confidence string, evidence_location string",
}
#: The older names of sections.
OLD_NAMES = {"microbe_relationships": "bacteria_relationships"}


def _items(papers: DataFrame, json_col: str, id_col: str, paths: list[str]) -> DataFrame:
    v = F.try_parse_json(json_col)
    lists = [F.try_variant_get(v, f"$.{p}", "array<variant>") for p in paths]
    return papers.select(id_col, F.posexplode(F.coalesce(*lists)).alias("pos", "item"))


def section(papers: DataFrame, json_col: str, id_col: str, name: str, domain: str = "bacteria") -> DataFrame:
    """id, pos and the fields of each entry of a section. An entry of another shape has nulls only. The older list of
    relationships stands in where the newer is missing; its entries get a domain."""
    names = [name, *([OLD_NAMES[name]] if name in OLD_NAMES else [])]
    found = _items(papers, json_col, id_col, names).select(id_col, "pos", F.try_variant_get("item", "$", f"struct<{SECTIONS[name]}>").alias("r")).select(id_col, "pos", "r.*")
    return found.withColumn("domain", F.coalesce("domain", F.lit(domain))) if name in OLD_NAMES else found


def contradictions(papers: DataFrame, json_col: str, id_col: str) -> DataFrame:
    """id, pos, text of the contradictions that an extraction states."""
    return _items(papers, json_col, id_col, ["extraction_metadata.contradictions_found"]).select(id_col, "pos", F.try_variant_get("item", "$", "string").alias("text"))


def steps(pathways: DataFrame, id_col: str) -> DataFrame:
    """A row a step of each pathway; pathways without steps stay, with nulls."""
    return pathways.select(id_col, "pos", F.posexplode_outer("steps").alias("step", "s")).select(id_col, "pos", "step", "s.*")


def incomplete(papers: DataFrame, json_col: str, id_col: str) -> DataFrame:
    """id, stated, listed where the stated number of microbes is not the number listed."""
    v = F.try_parse_json(json_col)
    meta = lambda f: F.try_variant_get(v, f"$.extraction_metadata.{f}", "long")
    size = lambda f: F.size(F.try_variant_get(v, f"$.{f}", "array<variant>"))
    counted = papers.select(id_col, F.coalesce(meta("total_microbes_found"), meta("total_bacteria_found")).alias("stated"), F.coalesce(size("microbe_relationships"), size("bacteria_relationships"), F.lit(0)).cast("long").alias("listed"))
    return counted.where("stated <> listed")


def chains(microbes: DataFrame, metabolites: DataFrame, id_col: str) -> DataFrame:
    """id, microbe, metabolite, outcome: a paper's microbes, what they produce, and what that goes with."""
    made = metabolites.select(id_col, F.explode("produced_by").alias("taxon_name"), F.col("name").alias("metabolite"), F.col("associated_outcome").alias("outcome"))
    # merged: a side whose rows pack well looks small enough to be broadcast, and would go through the driver whole
    return microbes.select(id_col, "taxon_name").distinct().hint("merge").join(made, [id_col, "taxon_name"]).select(id_col, F.col("taxon_name").alias("microbe"), "metabolite", "outcome").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """node, n_out, n_in of (src, dst)."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def accuracy_at(rank: Column, k: int) -> Column:
    """The share of rows whose right answer is among the first k; a null rank is a miss."""
    return F.avg(F.when(rank <= k, 1.0).otherwise(0.0))
