"""The opN queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import chat_format, edit_fingerprint, jaccard_join, lang_id, line_dedup, lm_score, merkle, mixing, packing, simhash, substring_dedup, topk


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_components(_table(spark, sf_dir, "documents"), shingle=3, percent=90)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer("byte_bpe_50k.json")
    return chat_format.digest(chat_format.format_turns(chat_format.with_probe(_table(spark, sf_dir, "conversations")), path), path)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (hex digest of the text that's left; null for a null text)."""
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), runs=True)
    return out.select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op8_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and near_class: the smallest doc_id that links of banded and verified fingerprints reach."""
    return edit_fingerprint.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings")).drop("exact_score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_manifest(_table(spark, sf_dir, "documents"))


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_score, op2_source_mixing, op3_substring_dedup, op4_jaccard_join, op5_best_fit_packing, op6_chat_format, op7_line_dedup, op8_edit_fingerprint, op9_exact_topk, op10_language_id, op11_merkle_manifest, op12_simhash_dedup)}


def oracle_sql() -> dict[str, str]:
    """Queries whose every column SQL can express; the others are tested against brute force."""
    return {"op3_substring_dedup": OP3_SQL, "op4_jaccard_join": OP4_SQL, "op6_chat_format": OP6_SQL, "op9_exact_topk": OP9_SQL, "op11_merkle_manifest": OP11_SQL}


OP3_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
m AS (SELECT g, min(doc_id) AS first FROM p GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM (SELECT p.doc_id, p.i FROM p JOIN m ON m.g = p.g WHERE m.first < p.doc_id)),
x AS (SELECT doc_id, generate_subscripts(ws, 1) AS k, unnest(ws) AS word FROM w),
kept AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.k) AS kept, count(*) AS n FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.k = x.k WHERE gone.k IS NULL GROUP BY x.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, k.component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) k ON k.a = w.doc_id
"""

OP6_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
x AS (SELECT *, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS shown, replace(replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), '\', '\\'), chr(10), '\n') AS named FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
sum(12 + length(named) + 1 + length(shown) + 10 + 1)::BIGINT AS formatted_chars FROM x GROUP BY conv_id
"""

OP9_SQL = """
WITH v AS (
    SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.n, q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
    FROM v q JOIN v c ON c.n <> q.n WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""

#: A leaf's digest is over its columns with their sizes; levels are reduced by a recursion over places in runs of eight, and each
#: leaf is folded again by another one. DuckDB has no crc32, so it is worked out a bit at a time.
OP11_SQL = """
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
  text, coalesce('=' || lang, '-') AS tree,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 3 = 0 AS changed FROM documents, crc),
h AS (SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h, sha256(head || coalesce(strlen(text) || ':' || CASE WHEN changed THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS claimed FROM d),
leaf AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM h),
node AS (SELECT 0 AS level, tree, pos, h, count(*) OVER (PARTITION BY tree) AS n FROM leaf
  UNION ALL SELECT level + 1, tree, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM node WHERE n > 1 GROUP BY level, tree, pos // 8),
subroot AS (SELECT tree, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos FROM node WHERE n = 1),
upper AS (SELECT 0 AS level, pos, h, count(*) OVER () AS n FROM subroot
  UNION ALL SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 7) // 8 FROM upper WHERE n > 1 GROUP BY level, pos // 8),
run AS (SELECT level, tree, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM node WHERE n > 1 GROUP BY ALL),
toprun AS (SELECT level, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM upper WHERE n > 1 GROUP BY ALL),
low AS (SELECT doc_id, tree, pos AS id, 0 AS level, pos, claimed AS h, '' AS proof FROM leaf
  UNION ALL SELECT doc_id, low.tree, id, low.level + 1, pos // 8, sha256(array_to_string(hs[:pos % 8], '') || h || array_to_string(hs[pos % 8 + 2:], '')), proof || array_to_string(hs[:pos % 8], '') || array_to_string(hs[pos % 8 + 2:], '') FROM low JOIN run ON run.level = low.level AND run.tree = low.tree AND run.run = pos // 8),
mid AS (SELECT tree, id, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM low GROUP BY tree, id),
high AS (SELECT mid.tree, id, 0 AS level, subroot.pos, mid.h, proof FROM mid JOIN subroot ON subroot.tree = mid.tree
  UNION ALL SELECT high.tree, id, high.level + 1, pos // 8, sha256(array_to_string(hs[:pos % 8], '') || h || array_to_string(hs[pos % 8 + 2:], '')), proof || array_to_string(hs[:pos % 8], '') || array_to_string(hs[pos % 8 + 2:], '') FROM high JOIN toprun ON toprun.level = high.level AND toprun.run = pos // 8),
top AS (SELECT tree, id, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM high GROUP BY tree, id)
SELECT leaf.doc_id, leaf.h AS leaf, subroot.h AS subroot, root.h AS root, sha256(top.proof) AS proof_sha256, top.h AS folded_root, top.h = root.h AS verified
FROM leaf JOIN top ON top.tree = leaf.tree AND top.id = leaf.pos JOIN subroot ON subroot.tree = leaf.tree, (SELECT h FROM upper WHERE n = 1) root
"""
