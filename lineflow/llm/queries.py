"""The queries of the operators, and SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineflow.llm import (
    byte_bpe,
    exact_dedup,
    graph_search,
    html_cut,
    katz,
    merkle,
    mixing,
    near_dedup,
    quality_rules,
    secret_ledger,
    token_shards,
    vector_codes,
    warc_derivatives,
)
from lineflow.llm.words import lower_ascii_column
from lineflow.workspace import scratch_path

BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_PATTERN = public_tokenizers.PATTERN
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.clean_documents(_read(spark, sf_dir, "documents")).drop("cleaned")


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    model = katz.fit(docs.filter(~held_out), scratch_path(spark, "katz"))
    return katz.score(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-shards")
    token_shards.write_shards(_read(spark, sf_dir, "documents"), path, WORD_TOKENIZER, end_id=2)
    return token_shards.shard_documents(spark, path)


def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_ledger.scan(_read(spark, sf_dir, "documents"), scratch_path(spark, "secret-ledger"))
    return secret_ledger.finding_digests(found)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(_read(spark, sf_dir, "documents"), words=3, percent=85)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = byte_bpe.encode_documents(_read(spark, sf_dir, "documents"), BYTE_RANKS, BYTE_PATTERN)
    return byte_bpe.token_digests(byte_bpe.decode_documents(encoded, BYTE_RANKS))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to WARC responses, these to derivatives, both through files; the derived records."""
    sources, derived = scratch_path(spark, "responses"), scratch_path(spark, "derivatives")
    warc_derivatives.write_warc(warc_derivatives.responses_of(_read(spark, sf_dir, "pages")), sources)
    warc_derivatives.write_warc(warc_derivatives.derive(warc_derivatives.read_warc(spark, sources)), derived)
    return warc_derivatives.record_digests(warc_derivatives.read_warc(spark, derived))


def op8_html_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_cut.extract_main_text(_read(spark, sf_dir, "pages"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_read(spark, sf_dir, "documents")).drop("n_chunks")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.curriculum(_read(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "passes")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    text = F.when(changed, lower_ascii_column(F.col("text"))).otherwise(F.col("text"))
    return merkle.audit(merkle.manifest(_read(spark, sf_dir, "documents"), text))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_read(spark, sf_dir, "embeddings"))


def op13_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return graph_search.nearest_neighbours(vectors, vectors.filter("vec_id % 20 = 0"))


QUERIES = (
    op1_quality_rules,
    op2_katz,
    op3_token_shards,
    op4_secret_ledger,
    op5_near_dedup,
    op6_byte_bpe,
    op7_warc,
    op8_html_cut,
    op9_exact_dedup,
    op10_mixing,
    op11_merkle,
    op12_vector_codes,
    op13_graph_search,
)

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_MIXED = r"""WITH docs AS (SELECT doc_id, source, md5(coalesce(cast(doc_id AS VARCHAR), '')) AS key,
        coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
    sources AS (SELECT source, cast(sum(size) AS BIGINT) AS source_size,
        row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM docs GROUP BY source),
    weighed AS (SELECT *, cast(place % 3 + 1 AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS cap FROM sources),
    ranked AS (SELECT *, row_number() OVER (ORDER BY cap / weight, place) AS rank,
        sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, place
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
        sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, place
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_rest FROM weighed),
    capped AS (SELECT *, cap * weight_rest <= weight * rest AS is_capped FROM ranked),
    level AS (SELECT min_by(rest / weight_rest, rank) AS level FROM capped WHERE NOT is_capped),
    targets AS (SELECT source, source_size, CASE WHEN is_capped THEN cap ELSE weight * level END AS target
        FROM capped, level),
    placed AS (SELECT doc_id, size, source_size, target, coalesce(sum(size) OVER (PARTITION BY docs.source
            ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS whole
        FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source),
    passed AS (SELECT *, cast(whole AS INTEGER) + CASE WHEN size > 0 AND whole < 3
        AND 2 * before + size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END AS passes FROM placed)
    """


#: Levels of a tree that the SQL writes out: trees of up to 8^9 leaves.
_HEIGHT = 9


def _crc32_table() -> list[int]:
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return table


def _merkle_sql() -> str:
    """Level by level: nodes are numbered, eight make one, and every row is folded along."""
    framed = "coalesce(strlen(cast({0} AS VARCHAR)) || ':' || cast({0} AS VARCHAR), '-')"
    fields = " || ".join(framed.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
    crc = f"""xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id AS VARCHAR), ''),
        lambda c: cast(ascii(c) AS BIGINT))), lambda crc, byte: xor({_crc32_table()}[xor(crc, byte) % 256 + 1], crc >> 8)))"""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def climb(step: str) -> str:
        """Tables of nodes, and of rows on their way up, until each tree is one node."""
        sql = ""
        for k in range(1, _HEIGHT + 1):
            below, rows = f"{step}_nodes{k - 1}", f"{step}_rows{k - 1}"
            sql += f""",
            {step}_nodes{k} AS MATERIALIZED (
                SELECT tree, place // 8 AS place, any_value((n + 7) // 8) AS n,
                    CASE WHEN any_value(n) = 1 THEN any_value(hash) ELSE sha256(string_agg(hash, '' ORDER BY place)) END AS hash
                FROM {below} GROUP BY tree, place // 8),
            {step}_rows{k} AS MATERIALIZED (
                SELECT row_no, tree, r.place // 8 AS place,
                    CASE WHEN any_value(s.n) = 1 THEN any_value(r.now) ELSE sha256(string_agg(
                        CASE WHEN s.place = r.place THEN r.now ELSE s.hash END, '' ORDER BY s.place)) END AS now,
                    any_value(r.proof) || coalesce(string_agg(s.hash, '' ORDER BY s.place) FILTER (s.place != r.place), '') AS proof
                FROM {rows} r JOIN {below} s USING (tree)
                WHERE s.place // 8 = r.place // 8 GROUP BY row_no, tree, r.place)"""
        return sql

    return f"""WITH leaves AS MATERIALIZED (
        SELECT *, row_number() OVER () AS row_no,
            row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n
        FROM (SELECT doc_id, CASE WHEN lang IS NULL THEN '-' ELSE '.' || lang END AS tree,
            sha256({fields} || {framed.format("text")}) AS leaf,
            sha256({fields} || CASE WHEN {crc} % 3 = 0 THEN {framed.format(lower)} ELSE {framed.format("text")} END) AS now
            FROM documents)),
        low_nodes0 AS MATERIALIZED (SELECT tree, place, n, leaf AS hash FROM leaves),
        low_rows0 AS MATERIALIZED (SELECT row_no, tree, place, now, '' AS proof FROM leaves){climb("low")},
        high_nodes0 AS MATERIALIZED (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS place,
            count(*) OVER () AS n, hash, tree AS lang_tree FROM low_nodes{_HEIGHT}),
        high_rows0 AS MATERIALIZED (SELECT row_no, '' AS tree, h.place, now, proof
            FROM low_rows{_HEIGHT} r JOIN high_nodes0 h ON r.tree = h.lang_tree){climb("high")}
        SELECT doc_id, leaf, h.hash AS subroot, top.hash AS root, sha256(proof) AS proof_sha256, f.now AS folded_root,
            f.now = top.hash AS verified
        FROM leaves l JOIN high_nodes0 h ON l.tree = h.lang_tree JOIN high_rows{_HEIGHT} f ON l.row_no = f.row_no
        JOIN high_nodes{_HEIGHT} top ON true"""


def _codes_sql() -> str:
    """Every part against every entry, four rounds and a last assignment."""
    parts, entries = vector_codes.PARTS, vector_codes.ENTRIES
    sql = f"""WITH kept AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS row_no, vec_id, label,
            list_transform(embedding, lambda x: cast(floor(1024 * cast(x AS DOUBLE)) AS BIGINT)) AS v, len(embedding) // {parts} AS width
        FROM embeddings WHERE embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(cast(x AS DOUBLE)))) = 0),
        cut AS MATERIALIZED (SELECT row_no, part, v[part * width + 1 : (part + 1) * width] AS p FROM kept, range({parts}) t(part)),
        book0 AS MATERIALIZED (SELECT part, row_no AS entry, p AS e FROM cut WHERE row_no < {entries})"""
    for k in range(vector_codes.ROUNDS + 1):
        sql += f""",
        near{k} AS MATERIALIZED (SELECT row_no, part, min(struct_pack(d := cast(list_sum(list_transform(list_zip(p, e),
                lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), entry := entry)) AS best
            FROM cut JOIN book{k} USING (part) GROUP BY row_no, part)"""
        if k < vector_codes.ROUNDS:
            sql += f""",
        mean{k} AS MATERIALIZED (SELECT part, entry, list(m ORDER BY place) AS e FROM (
            SELECT part, best.entry AS entry, place, cast((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
            FROM (SELECT part, best, unnest(p) AS x, generate_subscripts(p, 1) AS place FROM near{k} JOIN cut USING (row_no, part))
            GROUP BY part, best.entry, place) GROUP BY part, entry),
        book{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.e, b.e) AS e FROM book{k} b LEFT JOIN mean{k} m USING (part, entry))"""
    last = vector_codes.ROUNDS
    return sql + f""",
        coded AS (SELECT row_no, string_agg(format('{{:02x}}', best.entry), '' ORDER BY part) AS code,
            cast(sum(best.d) AS BIGINT) AS error FROM near{last} GROUP BY row_no)
        SELECT vec_id, code, error, cast(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
            (SELECT sha256(string_agg(x, ',' ORDER BY part, entry)) FROM (
                SELECT part, entry, array_to_string(e, ',') AS x FROM book{last})) AS codebooks_sha256
        FROM kept JOIN coded USING (row_no)"""


def oracle_sql() -> dict[str, str]:
    """SQL for DuckDB with the results of the queries."""
    return {
        "op9_exact_dedup": f"""WITH docs AS (SELECT doc_id, {_LOWER} AS text FROM documents)
            SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
            doc_id = max(doc_id) OVER same AS kept, sha256(text) AS text_sha256 FROM docs
            WINDOW same AS (PARTITION BY text)""",
        "op10_mixing": f"""{_MIXED} SELECT doc_id, cast(size AS BIGINT) AS size, source_size, target,
            cast(size * passes AS BIGINT) AS taken, passes FROM passed""",
        "op11_merkle": _merkle_sql(),
        "op12_vector_codes": _codes_sql(),
    }
