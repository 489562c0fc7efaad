"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm import best_fit, bpe_automaton, chunk_dedup, collocations, exact_dedup, html_text, jaccard_join, line_dedup, merkle, packing, secrets, toxicity, vector_topk
from tallymill.llm.storage import workers_can_import


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_can_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    """Path of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def packed_pieces(docs: DataFrame) -> DataFrame:
    """One row per piece; the ids as their CRC-32."""
    import public_tokenizers

    pieces = packing.pack(docs, _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256})
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe_automaton.encode_decode(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.repeated_spans(_table(spark, sf_dir, "documents"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = vector_topk.quantised(_table(spark, sf_dir, "embeddings"))
    return vector_topk.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.LEAST).cast("int").alias("predicted"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_copies(_table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    kind = secrets.KINDS.index
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == kind(k))).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in secrets.KINDS),
        F.sha2(secrets.span_text(F.filter("spans", lambda x: x["kind"] < kind("random"))), 256).alias("base_sha256"),
        secrets.span_text(F.col("spans")).alias("spans"),
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = merkle.proofs(merkle.build(merkle.document_leaves(_table(spark, sf_dir, "documents"), changed)))
    text = lambda digest: F.lower(F.hex(digest))
    folded = merkle.folded(text(F.coalesce("altered", "digest")), F.col("path"))
    found = found.select(
        F.col("id").alias("doc_id"), text("digest").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), merkle.path_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root")
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = best_fit.pack(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256})
    return found.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT a.vec_id AS query_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.q, b.q) DESC, b.vec_id)::INTEGER AS rank,
       b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 QUALIFY rank <= 10
"""

OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      WHEN len(w) >= 1 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""

OP8_SQL = r"""
WITH keyed AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM keyed WINDOW same AS (PARTITION BY text_sha256)
"""


def _merkle_sql(levels: int = 6, group_levels: int = 4) -> str:
    """Trees of up to 16 ** levels rows a source and 16 ** group_levels sources, level by level."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END"
    before = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bits = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [1000 + ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}::BIGINT[]), lambda a, x: CASE WHEN x >= 1000 THEN xor(a, x - 1000) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)"

    def tree(t: str, leaves: str, top: int) -> list[str]:
        """{t}0 .. {t}top: the nodes of each level; {t}r0 ..: its runs as lists."""
        out = [f"{t}0 AS ({leaves})"]
        for k in range(top):
            out += [
                f"{t}r{k} AS (SELECT s, pos // 16 AS pos, n, list(h ORDER BY pos) AS run FROM {t}{k} GROUP BY s, pos // 16, n)",
                f"{t}{k + 1} AS (SELECT s, pos, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS h FROM {t}r{k})",
            ]
        return out

    def fold(f: str, rows: str, t: str, top: int, at: str) -> list[str]:
        """{f}0 .. {f}top: rows with d folded up and the siblings met, proof."""
        out = [f"{f}0 AS ({rows})"]
        for k in range(top):
            nth = f"x.{at} // {16**k} % 16"
            left, right = f"array_to_string(run[1:{nth}], '')", f"array_to_string(run[{nth} + 2:], '')"
            out.append(f"{f}{k + 1} AS (SELECT x.* REPLACE (CASE WHEN r.n > 1 THEN sha256({left} || d || {right}) ELSE d END AS d, CASE WHEN r.n > 1 THEN proof || {left} || {right} ELSE proof END AS proof) FROM {f}{k} x JOIN {t}r{k} r ON r.s = x.{'s' if t == 't' else 'whole'} AND r.pos = x.{at} // {16 ** (k + 1)})")
        return out

    docs = f"SELECT doc_id, coalesce(':' || source, '-') AS s, sha256({before} || {field('text')}) AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN sha256({before} || {field(lower)}) END AS altered FROM documents"
    ctes = [
        f"d AS ({docs})",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY s) AS n FROM d)",
        *tree("t", "SELECT s, pos, n, leaf AS h FROM placed", levels),
        f"tops AS (SELECT s, h AS subroot, row_number() OVER (ORDER BY s) - 1 AS place, count(*) OVER () AS n FROM t{levels})",
        *tree("g", "SELECT '' AS s, place AS pos, n, subroot AS h FROM tops", group_levels),
        *fold("f", "SELECT p.*, coalesce(altered, leaf) AS d, '' AS proof, subroot, place, '' AS whole FROM placed p JOIN tops USING (s)", "t", levels, "pos"),
        *fold("u", f"SELECT * FROM f{levels}", "g", group_levels, "place"),
    ]
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, d AS folded_root, d = h AS verified FROM u{group_levels}, g{group_levels}"


OP11_SQL = _merkle_sql()

OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
  FROM words, range(1, 6) s(size) WHERE len(w) >= size),
counts AS (SELECT lang, phrase, any_value(size) AS size, count(*) AS f FROM grams GROUP BY lang, phrase),
totals AS (SELECT lang, sum(f)::HUGEINT AS n FROM counts WHERE size = 1 GROUP BY lang),
candidates AS (SELECT * FROM counts WHERE size >= 2 AND f >= 100),
parts AS (
  SELECT lang, phrase, f, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS lead, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest
  FROM candidates, range(1, 5) c(k) WHERE k < size),
cuts AS (
  SELECT p.lang, p.phrase, p.f AS a, p.k, x.f AS l, y.f AS r, t.n, (1000::HUGEINT * p.f * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM parts p JOIN counts x ON x.lang = p.lang AND x.phrase = p.lead JOIN counts y ON y.lang = p.lang AND y.phrase = p.rest JOIN totals t ON t.lang = p.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_phrases AS (
  SELECT c.lang, array_to_string(string_split(c.phrase, ' ')[i:i + n - 1], ' ') AS phrase, max(c.f) AS f
  FROM candidates c, range(1, 5) a(i), range(2, 5) b(n) WHERE n < size AND i + n - 1 <= size GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase)::BIGINT AS rank, b.phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM best b LEFT JOIN inner_phrases i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.f IS NULL OR 100 * i.f < 100 * a QUALIFY rank <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_substring_dedup, op3_exact_topk, op4_html_extraction, op5_toxicity, op6_line_dedup, op7_jaccard_join, op8_exact_dedup, op9_bpe_round_trip, op10_secret_scan, op11_merkle_manifest, op12_best_fit, op13_collocations)}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_topk": OP3_SQL, "op7_jaccard_join": OP7_SQL, "op8_exact_dedup": OP8_SQL, "op11_merkle_manifest": OP11_SQL, "op13_collocations": OP13_SQL}
