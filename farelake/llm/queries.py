"""One query for each operator, over its whole table, with production parameters."""

from functools import cache
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from farelake.llm import decontamination, manifest, near_vectors, neighbours, packing, quality, repeats, runs, simhash, token_counts, token_files, toxicity, warc


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _definition(name: str) -> str:
    with open(_vocabulary(name), encoding="utf-8") as file:
        return file.read()


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> Column:
    """Rows kept out of all learning: those whose CRC-32 of the id's text is divisible by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labels outside the held-out fold."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(~held_out()), sample=8000)
    return toxicity.score(model, docs).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_matches"
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents, and which exceed 4,096."""
    with open(_vocabulary("piece_bpe_32k.model"), "rb") as file:
        counts = token_counts.count_tokens(_table(spark, sf_dir, "documents"), file.read())
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one."""
    return neighbours.search(_table(spark, sf_dir, "embeddings"), queries="id % 100 = 0", k=10)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WARC records of all pages, written and read back; digest and size are taken anew from each payload read."""
    index = warc.write(_table(spark, sf_dir, "pages"), date="2024-01-01T00:00:00Z", least=100)
    return warc.read(spark, index).select(
        "page_id",
        F.coalesce(F.octet_length("payload"), "payload_bytes").cast("long").alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), "digest").alias("payload_digest"),
        "record_type", "refers_to",
    )


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents when strings of 50 bytes stay only in the first document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.remove_repeats(docs, length=50).select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.expr("aggregate(spans, 0L, (n, s) -> n + s.length)").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the groups that links of up to 4 bits make."""
    found = simhash.groups(_table(spark, sf_dir, "documents"), distance=4, width=4, seed=42)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def grades(labels: DataFrame) -> DataFrame:
    """Graded ratings: 0 for poor quality, 1 for good but toxic texts, 2 for good ones."""
    return labels.select("doc_id", F.expr("CASE WHEN quality = 0 THEN 0 WHEN toxic = 1 THEN 1 WHEN quality = 1 THEN 2 END").alias("grade"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade of all documents, learned outside the held-out fold; ``keep`` where grade 1 or better is likelier."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.fit(docs, grades(labels.filter(~held_out())), levels=3, sample=4000)
    return quality.score(model, docs, least=1).withColumn("keep", F.col("tail_probability") >= 0.5)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of all documents, each a sequence of its own."""
    sequences = packing.pack(_table(spark, sf_dir, "documents"), _definition("word_bpe_49k.json"), end=2, longest=4096)
    return sequences.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-id files of all documents, written and read back."""
    folder = token_files.write(_table(spark, sf_dir, "documents"), _definition("byte_bpe_50k.json"), end=0)
    return token_files.read(spark, folder, digests=True)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item or more, in runs of five words or more."""
    return decontamination.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), least=5, threshold=0.5)


def _planted(doc_id: int | None, n: int) -> np.ndarray:
    """Which word stands at each place: one document in ten repeats its words from some place on."""
    h = crc32(str(doc_id).encode())
    places = np.arange(n)
    if doc_id is None or h % 10:
        return places
    a = h // 10 % n
    period = 1 + (n - a) // (3 + h // 10 % 8)
    return np.where(places < a, places, a + (places - a) % period)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of the words of all documents, a tenth of which repeat themselves, and what is left without them."""
    found = runs.find_runs(_table(spark, sf_dir, "documents"), least=12, rewrite=_planted)
    longest = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    lines = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))")
    found = found.withColumn("longest", longest).select("*", "longest.length", (-F.col("longest.start")).alias("start"), (-F.col("longest.period")).alias("period"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period",
        F.expr("1000 * length div period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of all documents by language, and which rows still lead to its root when a seventh of them is altered."""
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = _table(spark, sf_dir, "documents").select(*columns)
    altered = docs.select("*", (F.col("n_chars") + 1).alias("altered"))
    digest = F.when(
        F.crc32(F.col("doc_id").cast("string")) % 7 == 0, manifest.row_digest("doc_id", "source", "lang", "altered", "text")
    )
    found = manifest.prove(altered, columns, carry={"altered": digest})
    found = found.withColumn("folded_root", manifest.fold(F.coalesce("altered", "leaf"), F.col("proof")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(manifest.siblings(F.col("proof")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label whose cosine is 0.98 or more: links, components, and one vector kept of each."""
    return near_vectors.near_copies(_table(spark, sf_dir, "embeddings"), least=0.98)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_token_counts": op2_token_counts,
    "op3_neighbours": op3_neighbours,
    "op4_warc": op4_warc,
    "op5_repeats": op5_repeats,
    "op6_simhash": op6_simhash,
    "op7_quality": op7_quality,
    "op8_packing": op8_packing,
    "op9_token_files": op9_token_files,
    "op10_decontamination": op10_decontamination,
    "op11_runs": op11_runs,
    "op12_manifest": op12_manifest,
    "op13_near_vectors": op13_near_vectors,
}

# DuckDB SQL for the queries that SQL can express.
ORACLE: dict[str, str] = {
    "op4_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), m AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY ALL)
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN first_id < page_id THEN first_id END AS refers_to
        FROM p LEFT JOIN m USING (payload_digest)""",
    "op12_manifest": """
        WITH RECURSIVE crc AS (
            SELECT doc_id, xor(list_reduce(
                list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
                lambda c, d: list_reduce(list_prepend(xor(c, d), list_value(0::BIGINT, 0, 0, 0, 0, 0, 0, 0)),
                    lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS value
            FROM (SELECT DISTINCT doc_id FROM documents)
        ), parts AS (
            SELECT doc_id, lang, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') ||
                coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
                coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS own,
                coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS altered,
                coalesce(strlen(text) || ':' || text, '-') AS tail
            FROM documents
        ), leaves AS (
            SELECT doc_id, coalesce('1' || lang, '0') AS tree, sha256(head || own || tail) AS leaf,
                CASE WHEN value % 7 = 0 THEN sha256(head || altered || tail) ELSE leaf END AS now,
                row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place
            FROM parts LEFT JOIN crc USING (doc_id)
        ), nodes(tree, level, place, h, n) AS (
            SELECT tree, 0, place, leaf, count(*) OVER (PARTITION BY tree) FROM leaves
            UNION ALL
            SELECT tree, level + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), (max(n) + 1) // 2
            FROM nodes WHERE n > 1 GROUP BY tree, level, place // 2
        ), subroots AS (
            SELECT tree, level AS height, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM nodes WHERE n = 1
        ), tops(level, place, h, n) AS (
            SELECT 0, place, subroot, count(*) OVER () FROM subroots
            UNION ALL
            SELECT level + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), (max(n) + 1) // 2
            FROM tops WHERE n > 1 GROUP BY level, place // 2
        ), tops_steps AS (
            SELECT t.tree, t.subroot, t.height, r.h AS root,
                list(CASE WHEN s.h IS NULL THEN '-' WHEN (t.place >> l.level) & 1 = 1 THEN 'L' || s.h ELSE 'R' || s.h END ORDER BY l.level)
                    FILTER (WHERE l.level < r.level) AS steps
            FROM subroots t CROSS JOIN (SELECT * FROM tops WHERE n = 1) r CROSS JOIN (SELECT DISTINCT level FROM tops) l
            LEFT JOIN tops s ON s.level = l.level AND s.place = xor(t.place >> l.level, 1)
            GROUP BY ALL
        ), steps AS (
            SELECT d.doc_id, d.tree, d.place, d.leaf, d.now, t.subroot, t.root, coalesce(t.steps, []) AS rest,
                coalesce(list(CASE WHEN s.h IS NULL THEN '-' WHEN (d.place >> l.level) & 1 = 1 THEN 'L' || s.h ELSE 'R' || s.h END
                    ORDER BY l.level) FILTER (WHERE l.level < t.height), []) AS own
            FROM leaves d JOIN tops_steps t USING (tree) CROSS JOIN (SELECT DISTINCT level FROM nodes) l
            LEFT JOIN nodes s ON s.tree = d.tree AND s.level = l.level AND s.place = xor(d.place >> l.level, 1)
            GROUP BY ALL
        ), folded AS (
            SELECT *, sha256(list_aggregate(list_transform(list_concat(own, rest), lambda s: s[2:]), 'string_agg', '')) AS proof,
                list_reduce(list_prepend(now, list_concat(own, rest)), lambda h, s: CASE s[1] WHEN 'L' THEN sha256(s[2:] || h)
                    WHEN 'R' THEN sha256(h || s[2:]) ELSE sha256(h) END) AS folded_root
            FROM steps
        )
        SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM folded""",
    "op13_near_vectors": """
        WITH RECURSIVE usable AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
            WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) >= 0.98 END
        ), reach(a, b) AS (
            SELECT vec_id, vec_id FROM embeddings
            UNION
            SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
        )
        SELECT e.vec_id, coalesce(n, 0) AS n_links, least AS component_id, least = e.vec_id AS kept
        FROM embeddings e JOIN (SELECT a, min(b) AS least FROM reach GROUP BY a) r ON r.a = e.vec_id
        LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = e.vec_id""",
}
