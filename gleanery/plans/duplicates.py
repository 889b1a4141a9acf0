"""Duplicate groups over digests: pairs, merged sets, survivors."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.operators import groups as G
from gleanery.session import table

#: md5 stands in for a picture's hash: it exercises the join, not a likeness. The share of bits is that of 40 in 256.
MOST_BITS = 20


def _hashed(spark, sf):
    lanes = G.hex_lanes(F.md5("text"), 2)
    return table(spark, sf, "documents").select("doc_id", "n_chars", lanes[0].alias("h0"), lanes[1].alias("h1"))


def hamming_pairs(spark, sf):
    """Pairs of the smallest ids of hashes, and every other id with the smallest of its hash."""
    return G.hamming_pairs(_hashed(spark, sf), "doc_id", ["h0", "h1"], MOST_BITS)


def _sets(spark, sf):
    """Exact copies, curated pairs (those of a list: a benchmark item's id and the one 10 above) and near hashes, by priority."""
    docs = table(spark, sf, "documents")
    keyed = docs.select("doc_id", F.md5("text").alias("digest"))
    first = keyed.groupBy("digest").agg(F.min("doc_id").alias("a"))
    exact = keyed.join(first, "digest").filter("doc_id <> a").select("a", F.col("doc_id").alias("b"), F.lit(0).alias("priority"))
    curated = table(spark, sf, "benchmark").filter("item_id % 20 < 10").select(F.col("item_id").alias("a"), (F.col("item_id") + 10).alias("b"), F.lit(1).alias("priority"))
    near = hamming_pairs(spark, sf).select("a", "b", F.lit(2).alias("priority"))
    return exact.unionByName(curated).unionByName(near)


def dup_components(spark, sf):
    return G.merged_sets(_sets(spark, sf))


def component_survivor(spark, sf):
    """Members that rules excluded still bridge sets but do not survive."""
    members = G.merged_sets(_sets(spark, sf)).join(table(spark, sf, "documents").select(F.col("doc_id").alias("node"), "n_chars", "lang"), "node")
    return G.survivors(members, F.col("lang") != "es", [F.desc("n_chars"), F.asc("node")])


QUERIES = {f.__name__: f for f in (hamming_pairs, dup_components, component_survivor)}
_H = "h AS (SELECT doc_id, ('0x' || substr(md5(text), 1, 16))::UBIGINT AS h0, ('0x' || substr(md5(text), 17, 16))::UBIGINT AS h1 FROM documents), r AS (SELECT h0, h1, min(doc_id) AS doc_id FROM h GROUP BY 1, 2)"
_NEAR = f"near AS (SELECT a.doc_id AS a, b.doc_id AS b, (bit_count(xor(a.h0, b.h0)) + bit_count(xor(a.h1, b.h1)))::INT AS bits FROM r a JOIN r b ON a.doc_id < b.doc_id WHERE bits <= {MOST_BITS} UNION ALL SELECT r.doc_id, h.doc_id, 0 FROM h JOIN r USING (h0, h1) WHERE h.doc_id <> r.doc_id)"
_SETS = f"""WITH RECURSIVE {_H}, {_NEAR}, k AS (SELECT doc_id, md5(text) AS digest FROM documents),
pairs AS (SELECT f.a, k.doc_id AS b, 0 AS priority FROM k JOIN (SELECT digest, min(doc_id) AS a FROM k GROUP BY 1) f USING (digest) WHERE k.doc_id <> f.a
UNION ALL SELECT item_id, item_id + 10, 1 FROM benchmark WHERE item_id % 20 < 10 UNION ALL SELECT a, b, 2 FROM near),
both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach(node, other) AS (SELECT a, a FROM both_ways UNION SELECT node, b FROM reach JOIN both_ways ON other = a),
labels AS (SELECT node, min(other) AS set_id FROM reach GROUP BY 1), kinds AS (SELECT set_id, min(priority) AS priority FROM pairs JOIN labels ON node = a GROUP BY 1),
sets AS (SELECT node, set_id, priority FROM labels JOIN kinds USING (set_id)) """
ORACLE_SQL = {
    "hamming_pairs": f"WITH {_H}, {_NEAR} SELECT * FROM near",
    "dup_components": _SETS + "SELECT * FROM sets",
    "component_survivor": _SETS + "SELECT node, set_id, rn = 1 AS kept FROM (SELECT node, set_id, row_number() OVER (PARTITION BY set_id ORDER BY n_chars DESC, node) AS rn, count(*) OVER (PARTITION BY set_id) AS n FROM sets JOIN documents ON doc_id = node WHERE lang <> 'es') WHERE n > 1",
}
