"""Sources, record parsing, normalising, keys and upserts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pairrank.functions.keys import artifact_key, content_sha, surrogate_id
from pairrank.functions.text import is_valid_structure, truncate
from pairrank.operators import keyed, records
from pairrank.plans.ingest import Ingestion
from pairrank.session import shared_dir
from pairrank.sources import catalog, raw_files, readers
from pairrank.sources.record_source import register_record_sources
from pairrank.workload.registry import query
from pairrank.workload.roles import compounds, interactions, proteins, table


@query(
    """
    WITH entries AS (
      SELECT source AS name, arg_max(lang, doc_id) AS lang FROM documents GROUP BY source
    ), routed AS (
      SELECT e.name,
             CASE e.lang WHEN 'en' THEN 'sdf' WHEN 'fr' THEN 'fasta' WHEN 'de' THEN 'csv' END AS reader,
             CASE e.lang WHEN 'en' THEN 'compound' WHEN 'fr' THEN 'protein' ELSE 'interaction' END AS entity_type
      FROM entries e
    )
    SELECT r.reader, r.entity_type, COUNT(*)::BIGINT AS n_loads,
           COUNT(DISTINCT d.source)::BIGINT AS n_sources, SUM(d.n_chars)::BIGINT AS n_chars
    FROM documents d LEFT JOIN routed r ON d.source = r.name
    GROUP BY r.reader, r.entity_type
    """
)
def route_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lang = F.col("lang")
    log = docs.select(
        F.col("source").alias("name"), "doc_id",
        F.when(lang == "en", "SDF").when(lang == "fr", "Fasta").when(lang == "de", "csv").otherwise("xml").alias("format"),
        F.when(lang == "en", "compound").when(lang == "fr", "protein").otherwise("interaction").alias("entity_type"),
    )
    entries = catalog.latest_entries(log, ["doc_id"]).drop("doc_id")
    return catalog.route(docs, entries, "source", ["n_chars"])


def molecules(parts, smiles, end="\n"):
    """One record of an SDF file for each part, without the line that ends it; a null structure is left out."""

    def item(name, value):
        return F.when(value.isNotNull(), F.concat(F.lit(f"> <{name}>\n"), value, F.lit("\n\n"))).otherwise("")

    text = F.concat(
        F.col("p_partkey").cast("string"),
        F.lit("\n  made\nthe V2000 of a comment\n  0  0  0  0  0  0            999 V2000\nM  END\n"),
        item("SMILES", smiles), item("brand", F.col("p_brand")), item("size", F.col("p_size").cast("string")),
    )
    return parts.select(F.replace(text, F.lit("\n"), F.lit(end)).alias("value"))


SDF_SQL = """
    SELECT CAST(p_partkey AS VARCHAR) AS external_id, replace(p_name, ' ', '=') AS smiles,
           p_brand AS brand, CAST(p_size AS VARCHAR) AS size, 2::BIGINT AS n_props
    FROM part
    """


def _parsed_molecules(parsed):
    return parsed.select(
        "external_id", "smiles", F.col("props")["brand"].alias("brand"), F.col("props")["size"].alias("size"),
        F.size("props").cast("bigint").alias("n_props"),
    )


@query(SDF_SQL)
def sdf_records(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return _parsed_molecules(readers.parse_sdf(molecules(parts, F.translate("p_name", " ", "="))))


def _sdf_files(spark, parts, smiles, end="\n"):
    """Writes the parts as SDF files; their folder."""
    folder = f"{shared_dir(spark)}/sdf/{uuid.uuid4().hex}"
    molecules(parts, smiles, end).withColumn("value", F.concat("value", F.lit(f"$$$${end[:-1]}"))).write.text(folder)
    return folder


@query(SDF_SQL)
def sdf_records_crlf(spark, sf_dir):
    """The parts as SDF files with Windows line ends, read back by separator."""
    parts = table(spark, sf_dir, "part")
    return _parsed_molecules(readers.read_sdf(spark, _sdf_files(spark, parts, F.translate("p_name", " ", "="), "\r\n")))


@query(SDF_SQL)
def sdf_source(spark, sf_dir):
    """The same through the ``sdf`` data source, in byte ranges smaller than most files."""
    register_record_sources(spark)
    parts = table(spark, sf_dir, "part")
    folder = _sdf_files(spark, parts, F.translate("p_name", " ", "="), "\r\n")
    return _parsed_molecules(readers.parse_sdf(spark.read.format("sdf").option("splitBytes", 50_000).load(folder), "record"))


def _loaded_twice(spark, sf_dir):
    """The parts as SDF files, loaded; then with another structure, or for small parts with none, loaded again."""
    parts = table(spark, sf_dir, "part")
    ingestion = Ingestion(spark, f"{shared_dir(spark)}/ingest/{uuid.uuid4().hex}", buckets=16)
    later = F.when(F.col("p_size") >= 26, F.translate("p_type", " ", "="))
    for version, smiles in (("v1", F.translate("p_name", " ", "=")), ("v2", later)):
        catalog.register_source("parts", catalog.Source("parts", _sdf_files(spark, parts, smiles), "SDF", "compound", version))
        ingestion.run_pipeline("parts")
    return ingestion


@query(
    """
    SELECT sha256('parts:' || p_partkey) AS id, 'parts' AS source, CAST(p_partkey AS VARCHAR) AS external_id,
           replace(CASE WHEN p_size >= 26 THEN p_type ELSE p_name END, ' ', '=') AS smiles, CAST(p_size AS VARCHAR) AS size
    FROM part
    """
)
def ingest_run(spark, sf_dir):
    """Whole runs: discover, store, parse, upsert; the second replaces what it has a structure for."""
    rows = _loaded_twice(spark, sf_dir).tables["compound"].read()
    return rows.select("id", "source", "external_id", "smiles", F.col("metadata")["size"].alias("size"))


@query(
    """
    SELECT 'parts' AS source, 'compound' AS entity_type, CAST(p_partkey AS VARCHAR) AS external_id, 'missing smiles' AS reason,
           p_brand AS brand
    FROM part WHERE p_size < 26
    """
)
def sdf_rejected(spark, sf_dir):
    """Records of the second run that were kept aside, with the reason and what was read of them."""
    rows = _loaded_twice(spark, sf_dir).rejected.read()
    return rows.select("source", "entity_type", "external_id", "reason", F.get_json_object("record", "$.metadata.brand").alias("brand"))


@query(
    """
    SELECT v.entity_type, v.status, count(*)::BIGINT AS runs, sum(v.n)::BIGINT AS rows_in, sum(v.bad)::BIGINT AS rows_rejected, 4::BIGINT AS stages
    FROM (SELECT 'compound' AS entity_type, 'COMPLETED' AS status, count(*) AS n, 0 AS bad FROM part
          UNION ALL SELECT 'compound', 'COMPLETED', count(*), count(*) FILTER (p_size < 26) FROM part) v
    GROUP BY v.entity_type, v.status
    """
)
def ingest_run_log(spark, sf_dir):
    """The runs' own log, and how many stages of them were timed."""
    runs = _loaded_twice(spark, sf_dir).runs()
    return runs.groupBy("entity_type", "status").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("rows_in").alias("rows_in"), F.sum("rows_rejected").alias("rows_rejected"),
        F.max(F.size("stages")).cast("bigint").alias("stages"),
    )


@query(
    """
    WITH s AS (SELECT doc_id, lang, source, regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]', '', 'g') AS seq FROM documents)
    SELECT 'doc' || doc_id AS external_id, 'doc' || doc_id || ' ' || lang || ' > ' || source AS description,
           sha256(seq) AS sequence_sha, length(seq)::BIGINT AS sequence_length
    FROM s
    """
)
def fasta_records(spark, sf_dir):
    # Blank lines and lines that start with '>' would end a record in a file; as one text
    # column per record they stay part of the sequence.
    docs = table(spark, sf_dir, "documents")
    header = F.concat(F.lit(">doc"), "doc_id", F.lit(" "), "lang", F.lit(" > "), "source", F.lit("\n"))
    parsed = readers.parse_fasta(docs.select(F.concat(header, "text").alias("value")))
    return parsed.select(
        "external_id", "description", content_sha(F.col("sequence")).alias("sequence_sha"),
        F.length("sequence").cast("bigint").alias("sequence_length"),
    )


@query(
    """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM orders
    """
)
def csv_records(spark, sf_dir):
    names = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate"]
    orders = table(spark, sf_dir, "orders").select(*names)
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string, o_orderdate timestamp"
    lines = orders.select(F.to_csv(F.struct(*names)).alias("line"))
    return lines.select(F.from_csv("line", schema).alias("r")).select("r.*").withColumn(
        "o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    )


@query(
    """
    SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS bytes,
           source || '/v1/' || sha256(text) || '/' || doc_id || '.txt' AS key
    FROM documents
    """
)
def content_address(spark, sf_dir):
    sha = content_sha(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", sha.alias("sha256"), F.octet_length("text").cast("bigint").alias("bytes"),
        artifact_key(F.col("source"), F.lit("v1"), sha, F.concat("doc_id", F.lit(".txt"))).alias("key"),
    )


@query(
    """
    SELECT d.doc_id, d.source, sha256(d.text) AS sha256 FROM documents d
    WHERE NOT EXISTS (
      SELECT 1 FROM documents s JOIN labels l ON s.doc_id = l.doc_id
      WHERE s.source = d.source AND sha256(s.text) = sha256(d.text))
    """
)
def new_artifacts_anti(spark, sf_dir):
    hashed = table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.lit("v1").alias("version"), content_sha(F.col("text")).alias("sha256")
    )
    stored = hashed.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return raw_files.new_artifacts(hashed, stored).select("doc_id", "source", "sha256")


@query(
    """
    SELECT CAST(p_partkey AS VARCHAR) AS external_id, p_brand AS source, replace(p_name, ' ', '=') AS smiles FROM part
    """
)
def scan_compounds(spark, sf_dir):
    return compounds(spark, sf_dir).select("external_id", "source", "smiles")


@query(
    """
    SELECT CAST(s_suppkey AS VARCHAR) AS external_id, 'nation' || s_nationkey AS source, s_name AS sequence FROM supplier
    """
)
def scan_proteins(spark, sf_dir):
    return proteins(spark, sf_dir).select("external_id", "source", "sequence")


@query(
    """
    WITH r AS (
      SELECT event_type AS source,
             coalesce(nullif(CASE WHEN event_type IN ('click', 'view') THEN '' ELSE 'e' || event_id END, ''),
                      'u' || user_id || '-' || event_id) AS external_id,
             props AS smiles
      FROM events)
    SELECT sha256(source || ':' || external_id) AS id, source, external_id, smiles FROM r
    """
)
def normalize_rows(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_type",
        F.when(F.col("event_type").isin("click", "view"), "").otherwise(F.concat(F.lit("e"), "event_id")).alias("external_id"),
        F.concat(F.lit("u"), "user_id", F.lit("-"), "event_id").alias("source_id"),
        F.col("props").alias("smiles"),
    )
    return records.to_rows(events, F.col("event_type"), "compound").select("id", "source", "external_id", "smiles")


@query(
    r"""
    WITH marks AS (
      SELECT page_id, unnest(regexp_extract_all(url, '[()]')) AS m,
             unnest(range(len(regexp_extract_all(url, '[()]')))) AS i FROM pages
    ), depth AS (
      SELECT page_id, SUM(CASE WHEN m = '(' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY i) AS d FROM marks
    ), round_bad AS (
      SELECT page_id FROM depth GROUP BY page_id HAVING MIN(d) < 0
      UNION SELECT page_id FROM marks GROUP BY page_id HAVING SUM(CASE WHEN m = '(' THEN 1 ELSE -1 END) <> 0
    ), smarks AS (
      SELECT page_id, unnest(regexp_extract_all(url, '[\[\]]')) AS m,
             unnest(range(len(regexp_extract_all(url, '[\[\]]')))) AS i FROM pages
    ), sdepth AS (
      SELECT page_id, SUM(CASE WHEN m = '[' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY i) AS d FROM smarks
    ), square_bad AS (
      SELECT page_id FROM sdepth GROUP BY page_id HAVING MIN(d) < 0
      UNION SELECT page_id FROM smarks GROUP BY page_id HAVING SUM(CASE WHEN m = '[' THEN 1 ELSE -1 END) <> 0
    ), v AS (
      SELECT regexp_full_match(url, '[A-Za-z0-9@+\-\[\]()=#$%/\\.:*~]+')
             AND page_id NOT IN (SELECT page_id FROM round_bad)
             AND page_id NOT IN (SELECT page_id FROM square_bad) AS ok
      FROM pages)
    SELECT COUNT(*)::BIGINT AS total, SUM(CASE WHEN ok THEN 1 ELSE 0 END)::BIGINT AS valid,
           SUM(CASE WHEN ok THEN 0 ELSE 1 END)::BIGINT AS invalid
    FROM v
    """
)
def valid_invalid_counts(spark, sf_dir):
    ok = is_valid_structure("url").cast("int")
    return table(spark, sf_dir, "pages").agg(
        F.count(F.lit(1)).alias("total"), F.sum(ok).alias("valid"), F.sum(1 - ok).alias("invalid")
    )


@query(
    """
    SELECT doc_id, sha256(substr(text, 1, 1024)) AS kept_sha, least(length(text), 1024)::BIGINT AS kept_length,
           length(text)::BIGINT AS full_length
    FROM documents
    """
)
def truncate_sequence(spark, sf_dir):
    """The length limit sequence models put on their input (1,024 letters)."""
    kept = truncate(F.col("text"), 1024)
    return table(spark, sf_dir, "documents").select(
        "doc_id", content_sha(kept).alias("kept_sha"), F.length(kept).cast("bigint").alias("kept_length"),
        F.length("text").cast("bigint").alias("full_length"),
    )


QUERY_TABLE = """
      SELECT conv_id, turn, CASE WHEN role = 'system' THEN '   ' ELSE text END AS query,
             CASE WHEN turn = 0 THEN 0 ELSE length(text) END AS top_k,
             CASE WHEN role = 'user' THEN 'Protein' WHEN role = 'assistant' THEN 'compound' ELSE 'dna' END AS entity_type
      FROM conversations
"""


@query(
    f"""
    WITH q AS ({QUERY_TABLE})
    SELECT conv_id, turn, md5(query) AS query_md5, top_k::BIGINT AS top_k, entity_type,
           CASE WHEN NOT regexp_matches(query, '\\S') THEN 'blank query'
                WHEN top_k NOT BETWEEN 1 AND 500 THEN 'top_k out of range'
                WHEN lower(entity_type) NOT IN ('protein', 'compound') THEN 'unknown entity_type' END AS reason
    FROM q
    """
)
def query_validation(spark, sf_dir):
    role = F.col("role")
    queries = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn",
        F.when(role == "system", "   ").otherwise(F.col("text")).alias("query"),
        F.when(F.col("turn") == 0, 0).otherwise(F.length("text")).cast("bigint").alias("top_k"),
        F.when(role == "user", "Protein").when(role == "assistant", "compound").otherwise("dna").alias("entity_type"),
    )
    return queries.select(
        "conv_id", "turn", F.md5("query").alias("query_md5"), "top_k", "entity_type",
        records.query_reason().alias("reason"),
    )


@query(
    """
    WITH u AS (
      SELECT CAST(o_custkey AS VARCHAR) AS external_id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status,
             arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS price
      FROM orders GROUP BY o_custkey
    ), t AS (SELECT CAST(c_custkey AS VARCHAR) AS external_id, c_mktsegment AS status, c_acctbal AS price, c_name AS id FROM customer)
    SELECT coalesce(t.external_id, u.external_id) AS external_id, 'shop' AS source,
           coalesce(t.id, sha256('shop:' || u.external_id)) AS id,
           CASE WHEN u.external_id IS NULL THEN t.status ELSE u.status END AS status,
           CASE WHEN u.external_id IS NULL THEN t.price ELSE u.price END AS price
    FROM t FULL OUTER JOIN u ON t.external_id = u.external_id
    """
)
def upsert_last_wins(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.lit("shop").alias("source"), F.col("o_custkey").cast("string").alias("external_id"),
        F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), "o_orderdate", "o_orderkey",
    )
    target = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("id"), F.lit("shop").alias("source"),
        F.col("c_custkey").cast("string").alias("external_id"),
        F.col("c_mktsegment").alias("status"), F.col("c_acctbal").alias("price"),
    )
    latest = keyed.last_wins(orders, ["o_orderdate", "o_orderkey"])
    updates = latest.withColumn("id", surrogate_id("source", "external_id"))
    return keyed.merge_payload(target, updates, ["status", "price"])


@query(
    """
    SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS external_id,
           l_partkey AS compound_id
    FROM lineitem WHERE l_partkey NOT IN (SELECT doc_id FROM labels)
    """
)
def fk_violations(spark, sf_dir):
    parents = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    rows = interactions(spark, sf_dir)
    return keyed.missing_parents(rows, parents, "compound_id").select("external_id", "compound_id")


@query(
    """
    SELECT l_partkey AS source, l_orderkey AS external_id, COUNT(*)::BIGINT AS n_rows
    FROM lineitem GROUP BY l_partkey, l_orderkey HAVING COUNT(*) > 1
    """
)
def duplicate_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("source"), F.col("l_orderkey").alias("external_id")
    )
    return keyed.duplicate_keys(rows)


@query(
    """
    WITH latest AS (
      SELECT l_orderkey || '-' || l_linenumber AS external_id,
             arg_max(l_partkey, (l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS part,
             arg_max(l_suppkey, (l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS supp,
             arg_max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END, (l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS label
      FROM lineitem GROUP BY l_orderkey, l_linenumber
    )
    SELECT sha256('shop:' || l.external_id) AS id, l.external_id,
           sha256('vectors:' || e.vec_id) AS compound_id,
           sha256('suppliers:' || s.s_suppkey) AS protein_id, 'binds' AS interaction_type, l.label,
           CASE WHEN e.vec_id IS NULL THEN 'unknown compound' END AS reason
    FROM latest l LEFT JOIN embeddings e ON l.part = e.vec_id LEFT JOIN supplier s ON l.supp = s.s_suppkey
    """
)
def interaction_ingest(spark, sf_dir):
    """Last row per key, parents looked up by (external_id, source), the lost ones marked."""
    items = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("external_id"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    )
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    # What follows from other columns is added to the rows that win, so that it is not shuffled.
    last = keyed.last_wins(items, order, ["external_id"]).select(
        "*",
        F.col("l_partkey").cast("string").alias("compound_external_id"), F.lit("vectors").alias("compound_source"),
        F.col("l_suppkey").cast("string").alias("protein_external_id"), F.lit("suppliers").alias("protein_source"),
    )
    latest = records.to_rows(last, "shop", "interaction")

    def parents(name, key, source):
        return table(spark, sf_dir, name).select(
            F.col(key).cast("string").alias("external_id"), F.lit(source).alias("source")
        ).withColumn("id", surrogate_id("source", "external_id"))

    resolved = keyed.resolve_interactions(
        latest, parents("embeddings", "vec_id", "vectors"), parents("supplier", "s_suppkey", "suppliers")
    )
    return resolved.select(
        "id", "external_id", "compound_id", "protein_id", "interaction_type", "label",
        keyed.unresolved_reason().alias("reason"),
    )


@query(
    """
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
           '{"type":"' || event_type || '","k":' || json_extract_string(props, '$.k') || '}' AS metadata
    FROM events
    """
)
def json_metadata(spark, sf_dir):
    parsed = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").select("event_id", "event_type", parsed.alias("k")).select(
        "event_id", "k", F.to_json(F.struct(F.col("event_type").alias("type"), "k")).alias("metadata")
    )
