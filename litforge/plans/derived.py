"""Registered queries over relation graphs, states that streams keep, and the vector index, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from litforge.operators import graph, index
from litforge.plans.forms import _j, scratch
from litforge.plans.queries import _LINES, query, table
from litforge.streaming import events as streams


def _extractions(spark, sf_dir):
    """An extraction with entries in all sections for each event."""
    n = lambda letter, of: _j(f'"{letter}', F.col("event_id") % of, '"')
    disease, treatment = _j('{"disease": {"primary_disease": ', n("d", 11), '}, "intervention": ', n("i", 3)), _j(', "microbe_relationships": [{"taxon_name": ', n("m", 13), ', "change_context": "disease_vs_control"}, {"taxon_name": ', n("m", 7), ', "change_context": "treatment_effect"}, {"taxon_name": null}]')
    made = _j(', "metabolites": [{"name": ', n("x", 5), ', "produced_by": [', n("m", 13), ", ", n("m", 6), '], "associated_outcome": ', n("o", 4), '}, {"name": "x9"}]')
    bonds = _j(', "microbe_interactions": [{"microbe_1": ', n("m", 13), ', "microbe_2": ', n("m", 10), '}], "host_factors": [{"factor": ', n("h", 2), ', "microbes": [', n("m", 13), "]}]")
    rest = _j(', "diversity_metrics": [{"metric_type": "shannon", "associated_outcome": ', n("o", 4), '}], "mechanistic_pathways": [{"steps": [{"name": ', n("m", 13), '}, {"name": ', n("x", 5), '}, {"name": ', n("o", 4), '}]}, {"steps": [{"name": "alone"}]}]}')
    return table(spark, sf_dir, "events").select("event_id", F.concat(disease, treatment, made, bonds, rest).alias("j"))


@query("""WITH n AS (SELECT event_id AS id, 'm' || event_id % 13 AS m, 'm' || event_id % 7 AS t, 'm' || event_id % 6 AS p, 'm' || event_id % 10 AS q, 'd' || event_id % 11 AS d, 'i' || event_id % 3 AS i, 'x' || event_id % 5 AS x, 'o' || event_id % 4 AS o, 'h' || event_id % 2 AS h FROM events)
SELECT id, m AS src, d AS dst, 'microbe_disease_association' AS rel FROM n UNION SELECT id, i, t, 'intervention_affects_microbe' FROM n UNION SELECT id, unnest([m, p]), x, 'microbe_produces_metabolite' FROM n
UNION SELECT id, x, o, 'metabolite_affects_outcome' FROM n UNION SELECT id, m, q, 'microbe_microbe_interaction' FROM n UNION SELECT id, q, m, 'microbe_microbe_interaction' FROM n
UNION SELECT id, h, m, 'host_factor_modifies_relationship' FROM n UNION SELECT id, 'shannon', o, 'diversity_outcome_association' FROM n UNION SELECT id, m, x, 'pathway_step' FROM n UNION SELECT id, x, o, 'pathway_step' FROM n""")
def relation_edges(spark, sf_dir):
    return graph.relations(_extractions(spark, sf_dir), "j", "event_id")


@query("""WITH RECURSIVE edge AS (SELECT 'u' || user_id AS src, 'u' || user_id // 2 AS dst FROM events UNION SELECT 'u' || user_id, event_type FROM events UNION SELECT event_type, 'u1' FROM events),
step AS (SELECT DISTINCT src, dst FROM edge WHERE src <> dst),
reach(src, dst, hops) AS (SELECT src, dst, 1 FROM step UNION SELECT r.src, e.dst, hops + 1 FROM reach r JOIN step e ON e.src = r.dst WHERE hops < 40)
SELECT src, dst, min(hops) AS hops FROM reach WHERE src <> dst GROUP BY 1, 2""")
def relation_chains(spark, sf_dir):
    """A tree of users over their event types, which lead back into it."""
    events = table(spark, sf_dir, "events")
    u = lambda c: F.concat(F.lit("u"), c.cast("string"))
    user = F.col("user_id")
    edges = events.select(F.explode(F.array(F.struct(u(user).alias("src"), u(F.floor(user / 2)).alias("dst")), F.struct(u(user).alias("src"), F.col("event_type").alias("dst")), F.struct(F.col("event_type").alias("src"), F.lit("u1").alias("dst")))).alias("e")).select("e.*")
    return graph.reached(edges, scratch(spark, "chains"))


@query("SELECT a.p AS item_1, b.p AS item_2, count(*) AS n FROM (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem) b ON a.o = b.o AND a.p < b.p GROUP BY 1, 2")
def bought_together(spark, sf_dir):
    return graph.together(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


def _in_parts(spark, rows, key: str, name: str, parts: int = 3):
    """A folder that rows arrive in, in parts, and the stream of it."""
    path = scratch(spark, name)
    for i in range(parts):
        rows.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i).write.mode("append").parquet(f"{path}/in")
        yield path, spark.readStream.schema(rows.schema).parquet(f"{path}/in")


@query(f"SELECT md5(chunk) AS chunk, arg_min(doc_id, (doc_id, pos)) AS doc_id, arg_min(pos, (doc_id, pos)) AS pos, count(*) AS n FROM ({_LINES.format('text')}) GROUP BY 1")
def stream_first_chunks(spark, sf_dir):
    """Different chunks with the place where each stands first, kept up to date over three arrivals of documents."""
    path = None
    for path, stream in _in_parts(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "first-chunks"):
        streams.keep(streams.first_chunks(stream), f"{path}/state", f"{path}/checkpoint")
    return streams.latest(spark, f"{path}/state", ["chunk_md5"]).select(F.col("chunk_md5").alias("chunk"), F.col("place.id").alias("doc_id"), F.col("place.pos").cast("int").alias("pos"), "n")


@query("SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY user_id")
def stream_rollup(spark, sf_dir):
    """The users' events summed up, kept up to date over arrivals; the state is compacted between them."""
    path = None
    for n, (path, stream) in enumerate(_in_parts(spark, table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "event_id", "rollup")):
        groups = stream.groupBy("user_id").agg(F.count("*").alias("n"), F.size(F.collect_set("event_type")).cast("long").alias("kinds"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))
        streams.keep(groups, f"{path}/state-{n // 2}", f"{path}/checkpoint")
        if n == 1:
            streams.compact(spark, f"{path}/state-0", f"{path}/state-1", ["user_id"])
    return streams.latest(spark, f"{path}/state-1", ["user_id"])


@query(None)
def nearest_by_index(spark, sf_dir):
    """The ten nearest vectors of every vector whose id is divisible by 20, through the index."""
    vectors = table(spark, sf_dir, "embeddings")
    cells = index.fit(vectors)
    path = scratch(spark, "index")
    index.assigned(vectors, cells).write.parquet(path)
    return index.search(vectors.where("vec_id % 20 = 0"), spark.read.parquet(path), cells)
