"""Queries of this package's operators, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinledger.llm import copies, frequency, mixing, near_duplicates, packing, relations, residue, salience, similar
from twinledger.runtime import table

def _both(spark: SparkSession, d: str, of) -> DataFrame:
    snapshot = table(spark, d, "snapshot")
    metadata = of(near_duplicates.similar_metadata(snapshot)).withColumn("field_name", F.lit("metadata_json"))
    return metadata.unionByName(of(near_duplicates.similar_names(snapshot)).withColumn("field_name", F.lit("name_norm")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _both(spark, d, similar.row_pairs).select("field_name", F.col("a").alias("row_id_a"), F.col("b").alias("row_id_b"))


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    """Of each record that took part: its class of equal sets, the copies in it and its number of similar records."""
    return _both(spark, d, similar.links).select("field_name", F.col("id").alias("row_id"), "class_id", "copies", "links")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copy_pairs(table(spark, d, "snapshot"))


def p2_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapsed(table(spark, d, "snapshot"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return relations.contract_groups(table(spark, d, "seed_relations"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return salience.scored(table(spark, d, "snapshot", "row_id", "metadata_json"), "row_id", "metadata_json", ~F.col("term").rlike(r"\p{N}"), 2)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The term of each record with the highest count x ln(N / records). This score is prescribed and orders terms otherwise than residuals do, so
    the residuals, which `p4_residual` ranks by, play no part here; counts and margins are the same table."""
    return salience.top_term(_scored(spark, d), "idf").select(F.col("record").alias("row_id"), "term")


def p4_residual(spark: SparkSession, d: str) -> DataFrame:
    """The term of each record with the highest adjusted residual."""
    best = salience.top_term(_scored(spark, d).withColumn("residual", F.round("residual", 6)), "residual")
    return best.select(F.col("record").alias("row_id"), "term", F.round("score", 3).alias("residual"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return frequency.snapshot_frequencies(table(spark, d, "snapshot")).filter("verdict <> 'rare'").select("field_name", "item", "verdict")


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return frequency.snapshot_frequencies(table(spark, d, "snapshot")).select("field_name", "item", "occurrences", "records", "verdict")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    capacities = [tuple(r) for r in table(spark, d, "pack_capacities", "capacity_id", "capacity_tokens").filter("capacity_id is not null and capacity_tokens is not null").orderBy("capacity_id").collect()]
    return packing.pack(table(spark, d, "documents", "doc_id", "text"), capacities)


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(_packed(spark, d))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents", "doc_id", "source", "text"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents", "doc_id", "source", "text"), table(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents")).select("doc_id")


def p10_clean(spark: SparkSession, d: str) -> DataFrame:
    """The clean corpus."""
    return residue.clean(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_links, p2_found, p2_collapsed, p3_found, p4_found, p4_residual, p6_found, p6_counts, p8_packed, p8_fill, p9_mixture, p9_shares, p10_found, p10_clean)}

_TERMS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_SETS = rf"""
m AS (SELECT row_id, list_distinct({_TERMS.format("metadata_json")}) s FROM snapshot WHERE metadata_json IS NOT NULL),
n AS (SELECT min(row_id) row_id, name_norm FROM snapshot WHERE length(name_norm) >= 8 GROUP BY name_norm),
s AS (SELECT 'metadata_json' f, row_id, s, 0.7 t FROM m WHERE len(s) >= 20
  UNION ALL SELECT 'name_norm', row_id, list_distinct([substring(name_norm, i, 3) FOR i IN range(1, length(name_norm) - 1)]), 0.5 FROM n),
e AS (SELECT f, row_id, t, len(s) size, unnest(s) x FROM s),
pairs AS (SELECT a.f field_name, a.row_id row_id_a, b.row_id row_id_b FROM e a JOIN e b ON a.f = b.f AND a.x = b.x AND a.row_id < b.row_id
  GROUP BY a.f, a.row_id, b.row_id, a.size, b.size, a.t HAVING count(*) >= a.t * (a.size + b.size - count(*)) - 1e-9)"""


def _uri(column: str) -> str:
    path = f"CASE WHEN instr({column}, '?') > 0 THEN left({column}, instr({column}, '?') - 1) ELSE {column} END"
    query = f"CASE WHEN instr({column}, '?') > 0 THEN substring({column}, instr({column}, '?') + 1) ELSE '' END"
    return f"list_concat({_TERMS.format(path)}, ['?'], list_sort(list_filter([array_to_string({_TERMS.format('p')}, ' ') FOR p IN string_split({query}, '&')], lambda x: x <> '')))"


_COPIES = f"""
k AS (SELECT row_id, {_TERMS.format("name_norm")} n, {_uri("token_uri_norm")} t, {_uri("image_uri_norm")} i FROM snapshot
  WHERE name_norm IS NOT NULL AND token_uri_norm IS NOT NULL AND image_uri_norm IS NOT NULL),
g AS (SELECT row_id, min(row_id) OVER w first, count(*) OVER w copies FROM k WHERE len(n) > 0 AND len(t) > 1 AND len(i) > 1 WINDOW w AS (PARTITION BY n, t, i))"""
_CELLS = f"""
d AS (SELECT row_id, {_TERMS.format("metadata_json")} ts FROM snapshot WHERE trim(metadata_json) <> ''),
c AS (SELECT row_id, term, count(*) n, any_value(r) r FROM (SELECT row_id, unnest(ts) term, len(ts) r FROM d) GROUP BY row_id, term),
v AS (SELECT term, sum(n) total, count(*) docs FROM c GROUP BY term),
x AS (SELECT row_id, term, n, r, total, docs, (SELECT sum(total) FROM v) g, (SELECT count(*) FROM d) num FROM c JOIN v USING (term)
  WHERE docs >= 2 AND NOT regexp_matches(term, '\\p{{N}}'))"""
_COUNTS = f"""
i AS (SELECT 'metadata_json' field_name, row_id, unnest({_TERMS.format("metadata_json")}) item FROM snapshot WHERE trim(metadata_json) <> ''
  UNION ALL SELECT 'token_uri_norm', row_id, token_uri_norm FROM snapshot WHERE trim(token_uri_norm) <> ''),
z AS (SELECT 'metadata_json' field_name, count(*) FILTER (WHERE trim(metadata_json) <> '') n FROM snapshot
  UNION ALL SELECT 'token_uri_norm', count(*) FILTER (WHERE trim(token_uri_norm) <> '') FROM snapshot),
q AS (SELECT field_name, item, count(*) occurrences, count(DISTINCT row_id) records FROM i GROUP BY ALL),
r AS (SELECT q.*, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.05 * n THEN 'common' ELSE 'useful' END verdict FROM q JOIN z USING (field_name))"""


def _end(chain: str, address: str) -> str:
    return f"CASE WHEN trim({address}) <> '' THEN lower(trim({chain})) || ':' || CASE WHEN lower(trim({chain})) = 'solana' THEN trim({address}) ELSE lower(trim({address})) END END"


ORACLES = {
    "p1_found": f"WITH {_SETS} SELECT * FROM pairs",
    "p1_links": f"""WITH {_SETS}, l AS (SELECT field_name, row_id_a row_id FROM pairs UNION ALL SELECT field_name, row_id_b FROM pairs),
        c AS (SELECT field_name, row_id, count(*) n FROM l GROUP BY ALL)
        SELECT s.f field_name, s.row_id, min(s.row_id) OVER w class_id, count(*) OVER w copies, coalesce(c.n, 0) links
        FROM s LEFT JOIN c ON c.field_name = s.f AND c.row_id = s.row_id WINDOW w AS (PARTITION BY s.f, list_sort(s.s))""",
    "p2_found": f"WITH {_COPIES} SELECT first row_id_a, row_id row_id_b FROM g WHERE row_id <> first",
    "p2_collapsed": f"WITH {_COPIES} SELECT row_id, copies FROM g WHERE row_id = first",
    "p3_found": f"""WITH RECURSIVE p AS (SELECT {_end("seed_chain", "seed_address")} a, {_end("candidate_chain", "candidate_address")} b FROM seed_relations),
        e AS (SELECT a, b FROM p WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM p WHERE a IS NOT NULL AND b IS NOT NULL),
        r AS (SELECT a v, a w FROM e UNION SELECT r.v, e.b FROM r JOIN e ON r.w = e.a)
        SELECT split_part(v, ':', 1) chain, substring(v, instr(v, ':') + 1) contract_address, min(w) group_key FROM r GROUP BY v""",
    "p4_found": f"WITH {_CELLS} SELECT row_id, arg_min(term, (-round(n * ln(num / docs), 6), term)) term FROM x GROUP BY row_id",
    "p4_residual": f"""WITH {_CELLS}, y AS (SELECT row_id, term, round((n - r * total / g) / sqrt(r * total / g * (1 - r / g) * (1 - total / g)), 6) s FROM x)
        SELECT row_id, arg_min(term, (-s, term)) term, round(max(s), 3) residual FROM y GROUP BY row_id""",
    "p6_found": f"WITH {_COUNTS} SELECT field_name, item, verdict FROM r WHERE verdict <> 'rare'",
    "p6_counts": f"WITH {_COUNTS} SELECT field_name, item, occurrences, records, verdict FROM r",
}
