"""The operators' queries over the given tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, conversation_repair, decontaminate, html_extract, lexical_search, line_dedup, minhash_dedup, pii, quality_qda, quality_trees, secret_scan, token_records, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.cluster(table(spark, sf_dir, "documents"), size=4)


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = token_records.write_records(table(spark, sf_dir, "documents"), vocabulary(), end_id=2)
    return token_records.read_shards(index)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.pairs(decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = quality_trees.train(docs, table(spark, sf_dir, "labels"))
    return quality_trees.judge(docs, trees)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op7_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_qda.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op11_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repaired(conversation_repair.damage(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Query] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_token_records": op2_token_records,
    "op3_url_filter": op3_url_filter,
    "op4_decontaminate": op4_decontaminate,
    "op5_quality_trees": op5_quality_trees,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality_qda": op7_quality_qda,
    "op8_secret_scan": op8_secret_scan,
    "op9_bpe": op9_bpe,
    "op10_pii": op10_pii,
    "op11_html_extract": op11_html_extract,
    "op12_lexical_search": op12_lexical_search,
    "op13_conversation_repair": op13_conversation_repair,
}

COMPONENTS = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c WHERE 100 * c >= 80 * (na + nb - c)), k AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, k.b FROM r JOIN k ON r.b = k.a), m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, len(s) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN m ON s.doc_id = m.a"""


def secrets_sql() -> str:
    """Spans of all rules by splitting at and extracting the same expression, as the operator defines them."""
    found = []
    for place, r in enumerate(secret_scan.RULES):
        p = r.pattern.replace("'", "''")
        found.append(
            f"""SELECT rid, '{r.kind}' AS kind, {place} AS place, {r.base} AS base, x.s AS s, x.e AS e FROM (SELECT rid, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'s': list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0), 'e': list_sum(list_transform(g[1:i], lambda y: length(y))) + list_sum(list_transform(m[1:i], lambda y: length(y))), 'l': length(t[i])}})) AS x
FROM (SELECT rid, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {r.group}) AS t, string_split_regex(text, '{p}') AS g FROM d WHERE regexp_matches(text, '{p}'))) WHERE x.l >= {r.least}"""
        )
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secret_scan.RULES if r.base)
    one = "kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, place, e"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents), f AS ({" UNION ALL ".join(found)}),
k AS (SELECT * FROM f WHERE base OR NOT EXISTS (SELECT 1 FROM f b WHERE b.base AND b.rid = f.rid AND b.s < f.e AND f.s < b.e))
SELECT doc_id, {counts}, sha256(coalesce(string_agg({one}) FILTER (base), '')) AS base_sha256, coalesce(string_agg({one}), '') AS spans FROM d LEFT JOIN k USING (rid) GROUP BY rid, doc_id"""


SEARCH = r"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
s AS (SELECT count(*) AS docs, sum(len(ws))::BIGINT AS words FROM t WHERE len(ws) > 0),
q AS (SELECT row_number() OVER () AS iid, item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
e AS (SELECT rid, doc_id, len(ws) AS size, unnest(ws) AS term FROM t),
p AS (SELECT rid, doc_id, size, term, count(*) AS tf FROM e WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, docs),
c AS (SELECT iid, item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * size * docs) // words))))::BIGINT AS score FROM q JOIN f USING (term) JOIN p USING (term), s GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM c WHERE score > 0)
SELECT * FROM r WHERE rank <= 50"""


ORACLE_SQL: dict[str, str] = {"op1_minhash_dedup": COMPONENTS, "op12_lexical_search": SEARCH, "op8_secret_scan": secrets_sql()}
