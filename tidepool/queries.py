"""The engine's own queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions import text as X
from tidepool.operators import chunking, index, lineage, messages, postings, ranking
from tidepool.operators.filters import eligible

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TERMS = ["the", "and", "tion", "in", "password", "der", "entre"]
SEARCH = "the password in was and on les der token by"
ALPHA = [x / 10 for x in range(64)]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def named(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return named


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quote(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def sql_tokens(x: str) -> str:
    """The SQL of functions.text.tokens."""
    stop = _quote(X.STOP_WORDS)
    words = f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9_]+(?:[.$/-][a-z0-9_]+)*'), lambda w: w NOT IN ({stop}))"
    parts = f"flatten(list_transform(list_filter({words}, lambda w: regexp_matches(w, '[.$/-]')), lambda w: list_filter(regexp_split_to_array(w, '[.$/-]'), lambda p: p <> '' AND p NOT IN ({stop}))))"
    runs = f"regexp_extract_all(lower({x}), '[\\x{{3400}}-\\x{{9fff}}\\x{{20000}}-\\x{{2fa1f}}]+')"
    pairs = f"flatten(list_transform({runs}, lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substring(r, i, 2)) END))"
    return f"list_concat(list_concat({words}, {parts}), {pairs})"


def sql_bm25(pool: str, terms: list[str]) -> str:
    """CTEs p, n and s: s has the pool's columns and score. ``pool`` selects what's needed and tok."""
    tf = ", ".join(f"len(list_filter(tok, lambda t: t = '{w}')) AS tf{i}" for i, w in enumerate(terms))
    df = ", ".join(f"sum((tf{i} > 0)::INT) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"CASE WHEN tf{i} > 0 THEN ln(1 + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a)) ELSE 0 END" for i in range(len(terms)))
    return f"""p AS (SELECT *, len(tok) AS l, {tf} FROM ({pool})),
n AS (SELECT count(*) AS n, coalesce(nullif(avg(l), 0), 1) AS a, {df} FROM p),
s AS (SELECT * FROM (SELECT p.*, {score} AS score FROM p, n) WHERE score > 0)"""


def note_rows(d: DataFrame) -> DataFrame:
    """documents as notes: the source is the folder, the id the file's stem and title."""
    stem = F.col("doc_id").cast("string")
    return d.select("doc_id", "lang", "source", F.concat(F.coalesce("source", F.lit("")), F.lit("/"), stem, F.lit(".md")).alias("path"), stem.alias("stem"), F.coalesce("text", F.lit("")).alias("text"))


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return note_rows(_t(spark, sf_dir, "documents"))


SQL_NOTES = "SELECT doc_id, lang, source, coalesce(source, '') || '/' || doc_id || '.md' AS path, doc_id::VARCHAR AS stem, coalesce(text, '') AS text FROM documents"


def _header(notes: DataFrame) -> Column:
    return X.header(title=F.col("stem"), filename=F.col("stem"), tags=F.col("lang"), project=F.col("source"))


SQL_HEADER = "concat_ws(chr(10), CASE WHEN stem <> '' THEN 'Title: ' || left(stem, 1600) END, CASE WHEN stem <> '' THEN 'Filename: ' || left(stem, 1600) END, CASE WHEN lang <> '' THEN 'Tags: ' || left(lang, 1600) END, CASE WHEN source <> '' THEN 'Project: ' || left(source, 1600) END)"


@query(f"SELECT path, sha256(text) AS fingerprint FROM ({SQL_NOTES})")
def corpus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _notes(spark, sf_dir).select("path", X.fingerprint(F.col("text")).alias("fingerprint"))


@query("""SELECT doc_id, path, CASE WHEN type <> '' THEN type WHEN lower(split_part(path, '/', 1)) IN ('lessons', '经验') THEN 'lesson' ELSE '' END AS kind
FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'article' ELSE '' END AS type,
      CASE doc_id % 3 WHEN 0 THEN 'Lessons' WHEN 1 THEN '经验' ELSE source END || '/' || doc_id || '.md' AS path FROM documents)""")
def derive_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.when(F.col("doc_id") % 3 == 0, F.lit("Lessons")).when(F.col("doc_id") % 3 == 1, F.lit("经验")).otherwise(F.col("source"))
    d = _t(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.lit("article")).otherwise(F.lit("")).alias("type"), F.concat(folder, F.lit("/"), F.col("doc_id"), F.lit(".md")).alias("path"))
    return d.select("doc_id", "path", X.kind(F.col("type"), F.col("path")).alias("kind"))


@query(f"""SELECT doc_id, header, sha256('1' || chr(10) || header || chr(10) || 'Section: ' || chr(10) || chr(10) || text) AS key
FROM (SELECT doc_id, text, {SQL_HEADER} AS header FROM ({SQL_NOTES}))""")
def passage_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _notes(spark, sf_dir)
    n = n.withColumn("header", _header(n))
    return n.select("doc_id", "header", X.passage_key(X.passage(F.col("header"), F.lit(""), F.col("text"))).alias("key"))


@query(f"SELECT doc_id, len({sql_tokens('text')}) AS n_tokens FROM ({SQL_NOTES})")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _notes(spark, sf_dir).select("doc_id", F.size(X.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query(f"SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({sql_tokens('text')})) AS term FROM ({SQL_NOTES})) WHERE term IN ({_quote(TERMS)}) GROUP BY term")
def term_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.document_frequency(_notes(spark, sf_dir).select(X.tokens(F.col("text")).alias("tokens")), TERMS)


def _top(scored: DataFrame, k: int) -> DataFrame:
    r = scored.select("doc_id", F.round("score", 6).alias("score"))
    return r.orderBy(F.col("score").desc(), "doc_id").limit(k)


def passages(notes: DataFrame, *more: str) -> DataFrame:
    """One passage per document, with its title and tags twice more, as search counts them."""
    extra = F.concat_ws(" ", "stem", "stem", "lang")
    whole = F.concat(X.passage(_header(notes), F.lit(""), F.col("text")), F.lit("\n"), extra, F.lit("\n"), extra)
    return notes.select("doc_id", *more, whole.alias("passage"))


def passage_tokens(notes: DataFrame, *more: str) -> DataFrame:
    """The passages' tokens."""
    return passages(notes, *more).select("doc_id", *more, X.tokens(F.col("passage")).alias("tokens"))


_EXTRA = "concat_ws(' ', stem, stem, lang)"
SQL_PASSAGE = f"({SQL_HEADER} || chr(10) || 'Section: ' || chr(10) || chr(10) || text || chr(10) || {_EXTRA} || chr(10) || {_EXTRA})"
_QT = X.query_terms(SEARCH)


@query(f"WITH {sql_bm25(f'SELECT doc_id, {sql_tokens(SQL_PASSAGE)} AS tok FROM ({SQL_NOTES})', _QT)} SELECT doc_id, round(score, 6) AS score FROM s ORDER BY score DESC, doc_id LIMIT 20")
def lexical_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(ranking.bm25(passage_tokens(_notes(spark, sf_dir)), _QT), 20)


_FILTERED = sql_bm25(f"SELECT doc_id, {sql_tokens(SQL_PASSAGE)} AS tok FROM ({SQL_NOTES}) WHERE lang = 'en'", _QT)


@query(f"WITH {_FILTERED} SELECT doc_id, round(score, 6) AS score FROM s ORDER BY score DESC, doc_id LIMIT 20")
def lexical_bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(ranking.bm25(passage_tokens(_notes(spark, sf_dir).filter("lang = 'en'")), _QT), 20)


@query(f"WITH {sql_bm25(f'SELECT doc_id, {sql_tokens(SQL_PASSAGE)} AS tok FROM ({SQL_NOTES})', _QT)} SELECT doc_id, round(score, 6) AS score FROM s WHERE round(score, 6) > 0 ORDER BY round(score, 6) DESC, doc_id LIMIT 20")
def indexed_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search of lexical_bm25 in a written index of all documents: texts are cut once, as it is built."""
    from tidepool.sources.files import scratch

    at = scratch(spark)
    notes = _notes(spark, sf_dir)
    postings.write(passages(notes), at, text="passage")
    return postings.best_documents(spark, at, passage_tokens(notes), _QT, 20)


def _many_cases() -> dict[int, tuple[list[str], str]]:
    """A hundred cases: pairs and triples of words, over all notes or those of a language."""
    words = ["the", "and", "in", "was", "on", "les", "der", "token", "by", "password", "de", "la", "die", "und", "el"]
    pools = ["", "en", "de", "fr", "es"]
    return {i: (sorted({words[i % 15], words[i * 7 % 15], *(words[(i + 4) % 15 :][:1] if i % 3 else [])}), pools[i % 5]) for i in range(100)}


_MANY = " UNION ALL ".join(f"SELECT {i} AS case_id, '{pool}' AS pool, unnest([{_quote(terms)}]) AS term" for i, (terms, pool) in _many_cases().items())


@query(f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, {sql_tokens(SQL_PASSAGE)} AS tok FROM ({SQL_NOTES})), q AS ({_MANY}),
g AS (SELECT DISTINCT pool FROM q), z AS (SELECT pool, count(*) AS n, coalesce(nullif(avg(len(tok)), 0), 1) AS a FROM g JOIN d ON pool IN ('', lang) GROUP BY pool),
h AS (SELECT doc_id, lang, len(tok) AS l, term, len(list_filter(tok, lambda t: t = term)) AS tf FROM d, (SELECT DISTINCT term FROM q) WHERE list_contains(tok, term)),
f AS (SELECT pool, term, count(*) AS df FROM g JOIN h ON pool IN ('', lang) GROUP BY pool, term),
s AS (SELECT case_id, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / a))), 6) AS score
  FROM q JOIN h ON h.term = q.term AND q.pool IN ('', h.lang) JOIN f ON f.pool = q.pool AND f.term = q.term JOIN z ON z.pool = q.pool GROUP BY case_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT case_id::INT AS case_id, doc_id, score, rank::INT AS rank FROM r WHERE rank <= 5""")
def evaluation_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred queries over all notes in one plan: five results each."""
    from pyspark.sql import Window

    notes = _notes(spark, sf_dir)
    rows = passage_tokens(notes, "lang")
    cases = {i: (terms, F.coalesce("lang", F.lit("")) == pool if pool else None) for i, (terms, pool) in _many_cases().items()}
    scored = ranking.bm25_many(rows, cases, names="int").select(F.col("case").alias("case_id"), "doc_id", F.round("score", 6).alias("score")).filter("score > 0")
    w = Window.partitionBy("case_id").orderBy(F.col("score").desc(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter("rank <= 5")


_SYN = " UNION ALL ".join(f"SELECT '{k}' AS word, '{v}' AS term" for k, vs in X.SYNONYMS.items() for v in vs)
_ASKED = ["数据库锁 timeout", "缓存 and 重试", "plugin 插件 loop", ""]
_QUERY = "left(text, 60) || ' ' || CASE turn % 4 " + " ".join(f"WHEN {i} THEN '{q}'" for i, q in enumerate(_ASKED)) + " END"


@query(f"""WITH q AS (SELECT conv_id, turn, {_QUERY} AS query FROM conversations WHERE role = 'user' AND text <> ''), y AS ({_SYN}),
t AS (SELECT conv_id, turn, unnest({sql_tokens('query')}) AS term FROM q UNION SELECT conv_id, turn, y.term FROM q JOIN y ON contains(q.query, y.word))
SELECT DISTINCT conv_id, turn, term FROM t""")
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users say, with words that have synonyms, as queries: the terms of each."""
    asked = F.get(F.array(*map(F.lit, _ASKED)), (F.col("turn") % 4).cast("int"))
    q = _t(spark, sf_dir, "conversations").filter("role = 'user' and text <> ''").select("conv_id", "turn", F.concat(F.substring("text", 1, 60), F.lit(" "), asked).alias("query"))
    return q.select("conv_id", "turn", F.explode(X.tokens(F.col("query"), expand=True)).alias("term")).distinct()


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _notes(spark, sf_dir).join(_t(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")), "doc_id", "left")
    status = F.when(F.col("toxic") == 1, F.lit("archived")).when(F.col("quality") == 1, F.lit("active")).when(F.col("quality") == 0, F.lit("draft")).otherwise(F.lit(""))
    globs = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("src/**/*.py"), F.lit("docs/?.md"))).when(F.col("doc_id") % 4 == 1, F.array(F.lit("lib/*"))).otherwise(F.array().cast("array<string>"))
    return n.select("doc_id", "path", status.alias("status"), F.when(F.col("doc_id") % 7 == 0, F.lit("global")).otherwise(F.col("source")).alias("project"), F.when(F.col("doc_id") % 2 == 0, F.lit("lesson")).otherwise(F.lit("article")).alias("kind"), F.when(F.col("doc_id") % 3 == 0, F.lit("db")).when(F.col("doc_id") % 3 == 1, F.lit("web")).otherwise(F.lit("")).alias("module"), globs.alias("path_globs"))


_LABELLED = f"""SELECT n.doc_id, n.path, CASE WHEN toxic = 1 THEN 'archived' WHEN quality = 1 THEN 'active' WHEN quality = 0 THEN 'draft' ELSE '' END AS status,
CASE WHEN n.doc_id % 7 = 0 THEN 'global' ELSE source END AS project, CASE WHEN n.doc_id % 2 = 0 THEN 'lesson' ELSE 'article' END AS kind,
CASE n.doc_id % 3 WHEN 0 THEN 'db' WHEN 1 THEN 'web' ELSE '' END AS module, n.doc_id % 4 AS g
FROM ({SQL_NOTES}) n LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON n.doc_id = l.doc_id"""


@query(f"""SELECT doc_id, path, status FROM ({_LABELLED}) WHERE kind = 'lesson' AND status = 'active' AND project IN ('src0', 'global') AND (module = '' OR module = 'db')
AND (g >= 2 OR (g = 0 AND (regexp_full_match('src/a/b.py', 'src/(?:.*/)?[^/]*\\.py') OR regexp_full_match('src/a/b.py', 'docs/[^/]\\.md'))) OR (g = 1 AND regexp_full_match('src/a/b.py', 'lib/[^/]*')))""")
def eligible_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).filter(eligible(recall=True, project="src0", module="db", path="src/a/b.py")).select("doc_id", "path", "status")


_GLOBS = ["**/*.html", "*/?*", "a*/**", "**"]


@query("SELECT page_id, p AS path, regexp_full_match(p, '(?:.*/)?[^/]*\\.html') AS g0, regexp_full_match(p, '[^/]*/[^/][^/]*') AS g1, regexp_full_match(p, 'a[^/]*/.*') AS g2, regexp_full_match(p, '.*') AS g3 FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*/?', '') AS p FROM pages)")
def glob_applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://[^/]*/?", "").alias("path"))
    return p.select("page_id", "path", *[X.glob_matches(g, F.col("path")).alias(f"g{i}") for i, g in enumerate(_GLOBS)])


_FOLDER, _NAME = "regexp_extract(p, '^(.*/)?[^/]*$', 1)", "regexp_extract(p, '[^/]*$', 0)"
_ESCAPED = lambda x: f"regexp_replace({x}, '([^A-Za-z0-9_/])', '\\\\\\1', 'g')"


@query(f"""WITH u AS (SELECT DISTINCT translate(regexp_replace(url, '^[a-z]+://[^/]*/?', ''), '?*', '__') AS p FROM pages WHERE url IS NOT NULL),
g AS (SELECT DISTINCT {_FOLDER} || '**' AS pattern, {_ESCAPED(_FOLDER)} || '.*' AS re FROM u UNION SELECT p, {_ESCAPED("p")} FROM u
  UNION SELECT '**/' || left({_NAME}, 2) || '*', '(?:.*/)?' || {_ESCAPED(f"left({_NAME}, 2)")} || '[^/]*' FROM u UNION SELECT '**/*' || right({_NAME}, 5), '(?:.*/)?[^/]*' || {_ESCAPED(f"right({_NAME}, 5)")} FROM u)
SELECT p AS path, pattern FROM u, g WHERE regexp_full_match(p, re) GROUP BY ALL""")
def glob_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of globs against all paths of pages: folders with anything below, whole paths, beginnings and ends of names."""
    u = _t(spark, sf_dir, "pages").filter("url is not null").select(F.translate(F.regexp_replace("url", "^[a-z]+://[^/]*/?", ""), "?*", "__").alias("path")).distinct()
    folder, name = F.regexp_extract("path", "^(.*/)?[^/]*$", 1), F.regexp_extract("path", "[^/]*$", 0)
    forms = [F.concat(folder, F.lit("**")), F.col("path"), F.concat(F.lit("**/"), F.substring(name, 1, 2), F.lit("*")), F.concat(F.lit("**/*"), F.right(name, F.lit(5)))]
    return X.glob_pairs(u, u.select(F.explode(F.array(*forms)).alias("glob")).distinct()).withColumnRenamed("glob", "pattern")


_LINES = sql_bm25(f"SELECT doc_id, ord, {sql_tokens('line')} AS tok FROM (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS ord, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM ({SQL_NOTES})))", _QT)


@query(f"WITH {_LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, ord) AS k FROM s) SELECT doc_id, ord::INT AS chunk_ord, round(score, 6) AS score FROM r WHERE k = 1")
def note_best_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _notes(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("chunk_ord", "line"))
    scored = ranking.bm25(lines.select("doc_id", "chunk_ord", X.tokens(F.col("line")).alias("tokens")), _QT)
    return ranking.best_chunk(scored.select("doc_id", "chunk_ord", F.round("score", 6).alias("score")), "doc_id")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    return e.filter(ranking.valid_vector(F.col("vector"), 64))


_ASK = "[" + ", ".join(f"{x}::DOUBLE" for x in ALPHA) + "]"
_COS = f"SELECT vec_id, list_dot_product(v, q) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(q, q)) AS score FROM (SELECT vec_id, embedding::DOUBLE[] AS v, {_ASK} AS q FROM embeddings)"


@query(f"SELECT vec_id, round(score, 6) AS score FROM ({_COS}) WHERE round(score, 6) >= 0.05 ORDER BY round(score, 6) DESC, vec_id LIMIT 20")
def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ranking.cosine(_vectors(spark, sf_dir), ALPHA, -1.0).select("vec_id", F.round("score", 6).alias("score"))
    return s.filter(F.col("score") >= 0.05).orderBy(F.col("score").desc(), "vec_id").limit(20)


@query(f"""SELECT least, vec_id, round(score, 6) AS score FROM ({_COS}), (SELECT unnest([0.05, 0.3]::DOUBLE[]) AS least) WHERE score >= least""")
def pruned_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors near a query in a table with angles to pivots, at two least scores."""
    from tidepool.operators import pivots
    from tidepool.sources.files import scratch

    at = scratch(spark)
    pivots.write(_vectors(spark, sf_dir), at)
    found = [pivots.near(spark, at, ALPHA, least).select(F.lit(least).alias("least"), "vec_id", F.round("score", 6).alias("score")) for least in (0.05, 0.3)]
    return found[0].unionByName(found[1])


@query("SELECT vec_id, (len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) > 0) AS valid, len(embedding)::INT AS dimensions, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def vector_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.select("vec_id", ranking.valid_vector(v, 64).alias("valid"), F.size(v).alias("dimensions"), F.round(ranking.norm(v), 6).alias("norm"))


def _branches(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    fts = ranking.bm25(passage_tokens(_notes(spark, sf_dir)), _QT).select("doc_id", F.round("score", 6).alias("score"))
    sem = ranking.cosine(_vectors(spark, sf_dir), ALPHA, -1.0).select(F.col("vec_id").alias("doc_id"), F.round("score", 6).alias("score")).filter("score >= 0.05")
    sem = sem.join(_notes(spark, sf_dir).select("doc_id"), "doc_id", "left_semi")
    return {k: ranking.ranked(b.withColumn("key", F.col("doc_id").cast("string")), "doc_id") for k, b in (("fts", fts), ("semantic", sem))}


_FTS = sql_bm25(f"SELECT doc_id, {sql_tokens(SQL_PASSAGE)} AS tok FROM ({SQL_NOTES})", _QT)
_BRANCHES = f"""WITH {_FTS}, f AS (SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s),
m AS (SELECT vec_id AS doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, vec_id) AS rank FROM ({_COS}) WHERE round(score, 6) >= 0.05 AND vec_id IN (SELECT doc_id FROM documents))"""


@query(f"""{_BRANCHES}, u AS (SELECT doc_id, 'fts' AS b, rank FROM f UNION ALL SELECT doc_id, 'semantic', rank FROM m)
SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, string_agg(b, ',' ORDER BY b) AS matched_by FROM u GROUP BY doc_id""")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.fuse(_branches(spark, sf_dir), "doc_id").select(F.col("path").alias("doc_id"), F.round("score", 6).alias("score"), F.array_join("matched_by", ",").alias("matched_by"))


@query(f"{_BRANCHES} SELECT doc_id, score, rank::INT AS rank, 'bm25' AS score_kind FROM f WHERE rank <= 10 UNION ALL SELECT doc_id, score, rank::INT, 'cosine' FROM m WHERE rank <= 10")
def single_mode_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _branches(spark, sf_dir)
    parts = [b[k].filter("rank <= 10").select("doc_id", "score", "rank", F.lit(kind).alias("score_kind")) for k, kind in (("fts", "bm25"), ("semantic", "cosine"))]
    return parts[0].unionByName(parts[1])


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each copy of a text is superseded by its next copy: runs over digests, so texts aren't sorted."""
    from pyspark.sql import Window

    d = _t(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    nxt = F.lead("doc_id").over(Window.partitionBy("h").orderBy("doc_id"))
    return d.withColumn("next", nxt).select(F.col("doc_id").alias("node"), F.col("next").isNotNull().alias("superseded"), "next")


_EDGE = "WITH RECURSIVE e AS (SELECT doc_id, lead(doc_id) OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) AS nxt FROM documents)"
_CHAIN = f"{_EDGE}, c AS (SELECT doc_id AS node, doc_id AS pos, ''::VARCHAR AS chain FROM e UNION ALL SELECT c.node, e.nxt, CASE WHEN c.chain = '' THEN c.pos::VARCHAR ELSE c.chain || ',' || c.pos END FROM c JOIN e ON e.doc_id = c.pos WHERE e.nxt IS NOT NULL), t AS (SELECT node, arg_max(pos, len(chain)) AS target, arg_max(chain, len(chain)) AS chain FROM c GROUP BY node)"


@query(f"{_CHAIN} SELECT node AS doc_id, target, chain FROM t")
def replacement_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.follow(_copies(spark, sf_dir)).select(F.col("node").alias("doc_id"), "target", F.array_join(F.transform("chain", lambda x: x.cast("string")), ",").alias("chain"))


_WALK = "(n_nationkey * 7 + 3) % 25"


@query(f"""WITH RECURSIVE w AS (SELECT n_nationkey AS node, n_nationkey AS pos, 0 AS k FROM nation UNION ALL SELECT w.node, (w.pos * 7 + 3) % 25, k + 1 FROM w WHERE w.pos % 6 <> 0 AND k < 60),
z AS (SELECT node, arg_max(pos, k) AS pos, max(k) AS k FROM w GROUP BY node)
SELECT node::BIGINT AS node, CASE WHEN pos % 6 = 0 THEN pos END::BIGINT AS target, CASE WHEN pos % 6 <> 0 THEN 'replacement_cycle' END AS problem FROM z""")
def replacement_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node"))
    links = n.select("node", (F.col("node") % 6 != 0).alias("superseded"), ((F.col("node") * 7 + 3) % 25).alias("next"))
    return lineage.follow(links).select("node", "target", "problem")


@query(f"{_CHAIN}, r AS (SELECT target, node, ((node * 37) % 101)::DOUBLE / 10 AS score FROM t), k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, node) AS i FROM r) SELECT target, node AS source, score FROM k WHERE i = 1")
def replacement_best_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lineage.follow(_copies(spark, sf_dir)).select("target", F.col("node").alias("source"), "chain", (((F.col("node") * 37) % 101) / F.lit(10.0)).alias("score"))
    return lineage.best_source(f).select("target", "source", "score")


@query("""WITH u AS (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY p_name HAVING count(*) = 1)
SELECT p.p_partkey AS node, u.k AS next FROM part p LEFT JOIN u ON u.p_name = p.p_name""")
def unique_stem_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    notes = p.select(F.concat(F.lit("parts/"), F.col("p_partkey"), F.lit(".md")).alias("path"), F.col("p_partkey").cast("string").alias("stem"), F.col("p_name").alias("title"))
    links = p.select(F.col("p_partkey").alias("node"), F.lit("parts").alias("folder"), F.col("p_name").alias("target"))
    found = lineage.resolve(links, notes)
    return found.select("node", F.regexp_extract("next", r"(\d+)", 1).try_cast("long").alias("next"))


def _index_state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """notes, chunks, vectors, old: an index that knew two thirds of the notes, and other texts for some."""
    n = _notes(spark, sf_dir).select("doc_id", "path", F.sha2("text", 256).alias("fingerprint"), F.col("text").alias("passage"))
    notes, chunks = n.filter("doc_id % 11 <> 0"), n.filter("doc_id % 11 <> 0").select(F.col("fingerprint").alias("key"), "passage")
    known = n.filter("doc_id % 3 <> 0")
    old = known.select("path", F.when(F.col("doc_id") % 5 == 0, F.lit("older")).otherwise(F.col("fingerprint")).alias("fingerprint"))
    return notes, chunks, known.select(F.col("fingerprint").alias("key")).distinct(), old


_STATE = f"WITH n AS (SELECT doc_id, path, sha256(text) AS f FROM ({SQL_NOTES})), now AS (SELECT * FROM n WHERE doc_id % 11 <> 0), vec AS (SELECT DISTINCT f AS key FROM n WHERE doc_id % 3 <> 0), old AS (SELECT path, CASE WHEN doc_id % 5 = 0 THEN 'older' ELSE f END AS f FROM n WHERE doc_id % 3 <> 0)"


@query(f"{_STATE} SELECT DISTINCT f AS key FROM now WHERE f NOT IN (SELECT key FROM vec)")
def index_missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, chunks, vectors, _ = _index_state(spark, sf_dir)
    return index.missing(chunks, vectors).select("key")


@query(f"{_STATE} SELECT key FROM vec WHERE key IN (SELECT f FROM now)")
def index_reused_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, chunks, vectors, _ = _index_state(spark, sf_dir)
    return index.reused(chunks, vectors)


@query(f"""{_STATE}, k AS (SELECT DISTINCT f FROM now), j AS (SELECT now.path AS a, old.path AS b, now.f AS x, old.f AS y FROM now FULL JOIN old ON now.path = old.path)
SELECT (SELECT count(*) FROM now) AS notes, (SELECT count(*) FROM k) AS chunks, (SELECT count(*) FROM k WHERE f IN (SELECT key FROM vec)) AS fresh_chunks,
(SELECT count(*) FROM k WHERE f NOT IN (SELECT key FROM vec)) AS missing_chunks, (SELECT count(*) FROM j WHERE b IS NULL) AS new_notes,
(SELECT count(*) FROM j WHERE x <> y) AS changed_notes, (SELECT count(*) FROM j WHERE a IS NULL) AS deleted_notes""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.coverage(*_index_state(spark, sf_dir))


@query(f"SELECT sha256(text) AS key, count(*) AS copies, min(doc_id) AS first_doc FROM ({SQL_NOTES}) GROUP BY sha256(text)")
def passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _notes(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("key"), F.col("text").alias("passage"))
    return index.passages(chunks, F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).drop("passage")


@query(f"""WITH {_FTS}, g AS (SELECT doc_id, lang, rank FROM (SELECT s.doc_id, d.lang, row_number() OVER (PARTITION BY d.lang ORDER BY round(score, 6) DESC, s.doc_id) AS rank FROM s JOIN documents d ON d.doc_id = s.doc_id) WHERE rank <= 5),
x AS (SELECT d.lang, l.doc_id FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND toxic = 0) l JOIN documents d ON d.doc_id = l.doc_id),
c AS (SELECT lang, count(*) AS expected FROM x GROUP BY lang),
h AS (SELECT x.lang, count(*) FILTER (WHERE rank <= 3) AS hits, min(rank) AS first FROM x JOIN g ON g.doc_id = x.doc_id GROUP BY x.lang)
SELECT c.lang, round(coalesce(hits, 0) / expected::DOUBLE, 6) AS recall_at_3, round(coalesce(1.0::DOUBLE / first, 0), 6) AS reciprocal_rank, coalesce(hits, 0) > 0 AS passed FROM c LEFT JOIN h ON h.lang = c.lang""")
def evaluation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    from tidepool.plans.evaluate import metrics

    fts = ranking.bm25(passage_tokens(_notes(spark, sf_dir), "lang"), _QT).select("doc_id", "lang", F.round("score", 6).alias("score"))
    w = Window.partitionBy("lang").orderBy(F.col("score").desc(), "doc_id")
    results = fts.withColumn("rank", F.row_number().over(w)).filter("rank <= 5").select(F.col("lang").alias("case"), F.col("doc_id").alias("path"), "rank")
    expected = _t(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0").select("doc_id").distinct().join(_notes(spark, sf_dir), "doc_id").select(F.col("lang").alias("case"), F.col("doc_id").alias("path"))
    m = metrics(results, expected)
    return m.select(F.col("case").alias("lang"), F.round("recall_at_3", 6).alias("recall_at_3"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"), "passed")


@query("""WITH s AS (SELECT conv_id, count(*) AS turns, arg_min(role, turn) AS first_role FROM conversations GROUP BY conv_id)
SELECT conv_id, turns, first_role, (SELECT count(*) FROM s) AS total, (SELECT count(*) FROM s) > 20 AS has_more FROM s ORDER BY turns DESC, conv_id DESC LIMIT 20""")
def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.sessions(_t(spark, sf_dir, "conversations"), 20)


_READ = "SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS number FROM conversations WHERE role IN ('user', 'assistant') AND coalesce(text, '') <> ''"


@query(f"SELECT conv_id, number, turn, role, length(text) AS n_chars FROM ({_READ})")
def message_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.readable(_t(spark, sf_dir, "conversations")).select("conv_id", "number", "turn", "role", F.length("text").cast("long").alias("n_chars"))


@query(f"SELECT * FROM (SELECT conv_id, number, text, max(number) OVER (PARTITION BY conv_id) > 5 AS has_more FROM ({_READ})) WHERE number > 2 AND number <= 5")
def message_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.page(messages.readable(_t(spark, sf_dir, "conversations")), 2, 3).select("conv_id", "number", "text", "has_more")


@query(f"SELECT conv_id, number, role, text FROM ({_READ}) WHERE number IN (2, 4, 5, 6)")
def message_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.select_numbers(messages.readable(_t(spark, sf_dir, "conversations")), "2,4-6").select("conv_id", "number", "role", "text")


@query(f"SELECT conv_id, number, CASE WHEN length(text) >= 25 THEN substring(text, 6, 20) END AS excerpt FROM ({_READ})")
def message_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.readable(_t(spark, sf_dir, "conversations")).select("conv_id", "number", messages.excerpt(F.col("text"), 5, 25).alias("excerpt"))


@query(f"""SELECT conv_id, number, '> [!' || CASE role WHEN 'user' THEN 'question] 你' ELSE 'success] Claude' END || ' · ' || printf('%02d', number) || chr(10) || '>' || chr(10) || '> ' || replace(text, chr(10), chr(10) || '> ') || chr(10) || chr(10) || '^message-' || printf('%02d', number) || chr(10) || chr(10) AS card FROM ({_READ})""")
def message_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages.readable(_t(spark, sf_dir, "conversations"))
    return m.select("conv_id", "number", X.message_card(F.col("role"), F.col("number"), F.lit(""), F.col("text"), "claude").alias("card"))


@query("""WITH d AS (SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H:%M') AS clock, lag(strftime(ts, '%Y-%m-%d')) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events)
SELECT event_id, user_id, day, clock, was IS NULL OR was <> day AS header FROM d""")
def day_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.day_headers(_t(spark, sf_dir, "events"), "ts", "user_id", ["ts", "event_id"]).select("event_id", "user_id", "day", "clock", "header")


_TAGGED = "CASE turn % 3 WHEN 0 THEN '# AGENTS.md instructions for here' || chr(10) || '<skill name=\"x\">use ' || chr(10) || ' it</skill> ' || chr(10) WHEN 1 THEN '<environment_context>cwd</environment_context>' || chr(10) ELSE '' END || text"
_RE = "^((?:\\s*# AGENTS\\.md instructions(?: for [^\\n]+)?[ \\t\\r\\f]*(?:\\n|\\z)|" + "|".join(f"\\s*<{t}(?:\\s+[^<>]*)?>(?s:.*?)</{t}>\\s*" for t in X.CONTEXT_TAGS) + ")+)"


@query(f"SELECT conv_id, turn, regexp_extract(t, '{_RE}', 1) AS context, substring(t, length(regexp_extract(t, '{_RE}', 1)) + 1) AS body FROM (SELECT conv_id, turn, {_TAGGED} AS t FROM conversations WHERE text IS NOT NULL)")
def context_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.when(F.col("turn") % 3 == 0, F.lit('# AGENTS.md instructions for here\n<skill name="x">use \n it</skill> \n')).when(F.col("turn") % 3 == 1, F.lit("<environment_context>cwd</environment_context>\n")).otherwise(F.lit(""))
    c = _t(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", F.concat(head, F.col("text")).alias("t"))
    c = c.withColumn("context", X.context_prefix(F.col("t")))
    return c.select("conv_id", "turn", "context", F.substring("t", F.length("context") + 1, F.length("t")).alias("body"))


@query("SELECT conv_id, sha256(string_agg(coalesce(text, '') || chr(10), '' ORDER BY turn, coalesce(text, ''))) AS version FROM conversations GROUP BY conv_id")
def session_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.version(_t(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


_TITLE = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"


@query(f"""WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(nfc_normalize({_TITLE}), '\\p{{C}}', '', 'g'), '[<>:"/\\\\|?*\\[\\]#^]', '-', 'g'), '\\s+', ' ', 'g'), ' .-') AS t FROM pages),
c AS (SELECT page_id, rtrim(left(t, list_max(list_filter(range(0, length(t) + 1), lambda n: strlen(left(t, n::INT)) <= 140))::INT), ' .-') AS t FROM t)
SELECT page_id, coalesce(nullif(t, ''), 'conversation') AS name FROM c""")
def filename_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    return _t(spark, sf_dir, "pages").select("page_id", X.filename_titles(title).alias("name"))


@query(r"SELECT page_id, coalesce(nullif(left(regexp_replace(regexp_replace(url, '[^\p{L}\p{M}\p{N}_-]', '-', 'g'), '^-+|-+$', '', 'g'), 60), ''), 'session') AS slug FROM pages")
def session_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", X.session_slug(F.col("url")).alias("slug"))


_HEADED = "CASE WHEN doc_id % 3 = 0 THEN 'first' || chr(10) || '# Title ' || doc_id || ' ' || chr(10) || '# Other' || chr(10) ELSE '' END || text"


@query(f"SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 5 = 0 THEN 'Given ' || doc_id ELSE '' END, ''), nullif(trim(regexp_extract({_HEADED}, '(?m)^#\\s+(.+)$', 1)), ''), stem) AS title FROM ({SQL_NOTES})")
def note_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _notes(spark, sf_dir)
    body = F.concat(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("first\n# Title "), F.col("doc_id"), F.lit(" \n# Other\n"))).otherwise(F.lit("")), F.col("text"))
    given = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Given "), F.col("doc_id"))).otherwise(F.lit(""))
    return n.select("doc_id", X.title(given, body, F.col("stem")).alias("title"))


_LINK_FORMS = [("[[A/", "|shown#x]]"), ("[x](a%20b", ".md#h)"), ("q100%-", ".md"), ("https://x.example/", ""), ("/abs/", ".md"), ("caf%C3%A9 ", "+c%23.md"), ("[y](%7", "%.md)"), (" ", "")]
_LINKS = "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{a}' || doc_id || '{b}'" for i, (a, b) in enumerate(_LINK_FORMS)) + " END"


@query(f"""WITH l AS (SELECT doc_id, {_LINKS} AS link, trim({_LINKS}) AS t FROM documents), p AS (SELECT *, coalesce(nullif(regexp_extract(t, '^\\[[^\\]]*\\]\\((.+)\\)$', 1), ''), t) AS p FROM l),
d AS (SELECT *, CASE WHEN t LIKE '[[%]]' THEN regexp_extract(t, '^\\[\\[([^|#]*)', 1) ELSE split_part(url_decode(regexp_replace(p, '%($|[^0-9A-Fa-f]|[0-9A-Fa-f][^0-9A-Fa-f])', '%25\\1', 'g')), '#', 1) END AS x FROM p)
SELECT doc_id, link, CASE WHEN x <> '' AND NOT contains(x, '://') AND NOT starts_with(x, '/') THEN x END AS target FROM d""")
def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = F.array(*[F.concat(F.lit(a), F.col("doc_id"), F.lit(b)) for a, b in _LINK_FORMS])
    d = _t(spark, sf_dir, "documents").select("doc_id", F.get(forms, (F.col("doc_id") % 8).cast("int")).alias("link"))
    return d.select("doc_id", "link", X.link_target(F.col("link")).alias("target"))


@query(f"SELECT doc_id, path, project FROM ({_LABELLED}) WHERE status = 'draft' AND kind = 'article' AND (path = 'src1' OR starts_with(path, 'src1/'))")
def filter_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).filter(eligible(status="draft", kind="article", folder="src1/")).select("doc_id", "path", "project")


@query(f"""SELECT doc_id, status, kind FROM (SELECT * REPLACE (CASE WHEN status = 'archived' THEN 'superseded' ELSE status END AS status) FROM ({_LABELLED}))
WHERE project IN ('src0', 'global') AND (module = '' OR module = 'web') AND (status = 'superseded' OR (status = 'active' AND kind = 'lesson'))""")
def recall_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepool.plans.search import Request

    rows = _labelled(spark, sf_dir).withColumn("status", F.when(F.col("status") == "archived", F.lit("superseded")).otherwise(F.col("status")))
    return rows.filter(Request("x", recall=True, project="src0", module="web").pool()).select("doc_id", "status", "kind")


@query(f"{_CHAIN}, r AS (SELECT target, node, chain, ((node * 37) % 101)::DOUBLE / 10 AS score FROM t) SELECT target, count(*) AS sources, string_agg(chain, '|' ORDER BY score DESC, node) AS chains FROM r GROUP BY target")
def replacement_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lineage.follow(_copies(spark, sf_dir)).select("target", F.col("node").alias("source"), "chain", (((F.col("node") * 37) % 101) / F.lit(10.0)).alias("score"))
    shown = F.transform("chains", lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ","))
    return lineage.best_source(f).select("target", F.size("chains").cast("long").alias("sources"), F.array_join(shown, "|").alias("chains"))


@query("""WITH d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE lang IS NOT NULL),
g AS (SELECT * FROM d WHERE rank <= 5), l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
x AS (SELECT d.lang, d.doc_id, d.rank FROM d JOIN l ON l.doc_id = d.doc_id WHERE quality = 1 AND toxic = 0),
c AS (SELECT lang, count(*) AS expected, count(*) FILTER (WHERE rank <= 3) AS hits, min(rank) FILTER (WHERE rank <= 5) AS first FROM x GROUP BY lang),
f AS (SELECT g.lang, string_agg(g.doc_id::VARCHAR, ',' ORDER BY g.doc_id::VARCHAR) AS leaked FROM g JOIN l ON l.doc_id = g.doc_id WHERE coalesce(quality, 0) = 0 OR toxic = 1 GROUP BY g.lang)
SELECT c.lang, round(hits / expected::DOUBLE, 6) AS recall_at_3, round(coalesce(1.0::DOUBLE / first, 0), 6) AS reciprocal_rank, coalesce(leaked, '') AS forbidden_hits, hits > 0 AND leaked IS NULL AS passed FROM c LEFT JOIN f ON f.lang = c.lang""")
def forbidden_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    from tidepool.plans.evaluate import metrics

    d = _t(spark, sf_dir, "documents").filter("lang is not null").select(F.col("lang").alias("case"), F.col("doc_id").alias("path"), "n_chars")
    label = _t(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("path")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    w = Window.partitionBy("case").orderBy(F.col("n_chars").desc_nulls_last(), "path")
    results = d.withColumn("rank", F.row_number().over(w)).filter("rank <= 5").select("case", "path", "rank")
    known = d.select("case", "path").join(label, "path")
    m = metrics(results, known.filter("quality = 1 and toxic = 0"), known.filter("coalesce(quality, 0) = 0 or toxic = 1"))
    return m.select(F.col("case").alias("lang"), F.round("recall_at_3", 6).alias("recall_at_3"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"), F.array_join("forbidden_hits", ",").alias("forbidden_hits"), "passed")


@query("""WITH s AS (SELECT user_id, max(ts) AS t, count(*) AS turns FROM events GROUP BY user_id)
SELECT user_id, strftime(t, '%Y-%m-%d %H:%M:%S.%f') AS modified_at, turns, (SELECT count(*) FROM s) AS total, (SELECT count(*) FROM s) > 15 AS has_more FROM s ORDER BY t DESC, user_id DESC LIMIT 15""")
def recent_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.latest(_t(spark, sf_dir, "events"), "user_id", "ts", 15).withColumn("modified_at", F.date_format("modified_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def _keyed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """chunks (path, chunk_ord, key) and vectors (key, vector): passages that are equal have one vector, of their smallest id."""
    n = _notes(spark, sf_dir).select("doc_id", "path", "lang", F.sha2("text", 256).alias("key"), F.lit(0).alias("chunk_ord"))
    of = n.groupBy("key").agg(F.min("doc_id").alias("vec_id"))
    return n, of.join(_vectors(spark, sf_dir), "vec_id").select("key", "vector")


_KEYED = f"""WITH n AS (SELECT doc_id, path, lang, sha256(text) AS key FROM ({SQL_NOTES})), k AS (SELECT key, min(doc_id) AS vec_id FROM n GROUP BY key),
v AS (SELECT k.key, c.score FROM k JOIN ({_COS}) c ON c.vec_id = k.vec_id)"""


@query(f"{_KEYED} SELECT n.path, n.key, round(v.score, 6) AS score FROM n JOIN v ON v.key = n.key WHERE n.lang = 'en' AND round(v.score, 6) >= 0.02")
def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, vectors = _keyed(spark, sf_dir)
    hits = ranking.cosine(chunks.filter("lang = 'en'").join(vectors, "key"), ALPHA, -1.0).withColumn("score", F.round("score", 6)).filter("score >= 0.02")
    return ranking.best_chunk(hits.select("path", "key", "chunk_ord", "score")).select("path", "key", "score")


@query(f"{_KEYED} SELECT count(DISTINCT key) AS chunks, count(DISTINCT key) FILTER (WHERE key NOT IN (SELECT key FROM v)) AS missing_chunks FROM n WHERE lang = 'en'")
def relevant_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, vectors = _keyed(spark, sf_dir)
    pool = chunks.filter("lang = 'en'").select("path")
    relevant = chunks.withColumn("passage", F.lit("")).join(pool, "path", "left_semi")
    lacking = index.missing(relevant, vectors).agg(F.count("*").alias("missing_chunks"))
    return relevant.agg(F.count_distinct("key").alias("chunks")).crossJoin(lacking)  # one row each


@query("""SELECT p_partkey, 0 AS chunk_ord, 1 AS start_line, 4 AS end_line, '' AS heading, sha256('intro' || chr(10) || '```' || chr(10) || '# no heading' || chr(10) || '```' || chr(10)) AS digest FROM part
UNION ALL SELECT p_partkey, 1, 5, 6, 'Quoted ' || p_partkey, sha256('> ## Quoted ' || p_partkey || chr(10) || p_name) FROM part""")
def quoted_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A heading in a block quote, after one in a fence that is none, before each part's name."""
    body = F.concat(F.lit("intro\n```\n# no heading\n```\n> ## Quoted "), F.col("p_partkey"), F.lit("\n"), F.col("p_name"))
    c = chunking.split_rows(_t(spark, sf_dir, "part").select("p_partkey", body.alias("text")), "p_partkey", "text")
    return c.select("p_partkey", "chunk_ord", "start_line", "end_line", "heading", F.sha2("text", 256).alias("digest"))


_PLACES = [("pic/", "%20x.png"), ("file:///a/", "%20x.png"), ("C:/x/", ".png"), ("file://far/x/", ".png"), ("ftp://x/", ".png"), ("file://localhost/b/", ".png"), ("file:///D:/x/", ".png")]


@query(f"""SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'pic/' || page_id || ' x.png' WHEN 1 THEN '/a/' || page_id || ' x.png' WHEN 5 THEN '/b/' || page_id || '.png' END AS posix,
CASE page_id % 7 WHEN 0 THEN 'pic/' || page_id || ' x.png' WHEN 1 THEN '\\a\\' || page_id || ' x.png' WHEN 2 THEN 'C:/x/' || page_id || '.png' WHEN 5 THEN '\\b\\' || page_id || '.png' WHEN 6 THEN 'D:\\x\\' || page_id || '.png' END AS windows FROM pages""")
def image_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepool.operators.images import local_paths

    forms = F.array(*[F.concat(F.lit(a), F.col("page_id"), F.lit(b)) for a, b in _PLACES])
    p = _t(spark, sf_dir, "pages").select("page_id", F.get(forms, (F.col("page_id") % 7).cast("int")).alias("r"))
    return p.select("page_id", local_paths("r", F.lit(False)).alias("posix"), local_paths("r", F.lit(True)).alias("windows"))


@query("SELECT conv_id, 2 * count(*) AS images, count(*) AS remote, count(DISTINCT turn) + count(DISTINCT turn % 2) AS captured FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def image_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepool.operators.images import reference_counts, references

    c = _t(spark, sf_dir, "conversations").filter("text is not null")
    written = F.concat("text", F.lit("\n![a](https://x.example/"), F.col("turn"), F.lit(".png) `![b](no.png)` ![c](<pic/"), F.col("turn") % 2, F.lit(".png>)\n"))
    return reference_counts(references(c.select("conv_id", "turn", written.alias("text")), ["conv_id", "turn"], "text"), "conv_id")


@query("""WITH e AS (SELECT *, conv_id % 4 AS file, row_number() OVER (PARTITION BY conv_id % 4 ORDER BY conv_id, turn) AS line FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line) AS number FROM e WHERE role IN ('user', 'assistant') AND coalesce(text, '') <> '')
SELECT file, number::INT AS number, line::INT AS line, role, 0 AS images, '2026-01-01T00:00:' || lpad((turn % 60)::VARCHAR, 2, '0') || 'Z' AS timestamp, sha256(text) AS digest FROM r""")
def session_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations written as four logs, and read back by the source of logs: one stream a file."""
    from tidepool.sources.files import mounted, scratch
    from tidepool.sources.sessions import read_log

    at, c = scratch(spark), _t(spark, sf_dir, "conversations")
    said = F.struct(F.col("role"), F.array(F.struct(F.lit("text").alias("type"), F.col("text"))).alias("content"))
    stamp = F.concat(F.lit("2026-01-01T00:00:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.lit("Z"))
    row = F.to_json(F.struct(F.col("role").alias("type"), stamp.alias("timestamp"), F.lit("/w").alias("cwd"), F.col("conv_id").cast("string").alias("sessionId"), said.alias("message")))
    rows = c.select((F.col("conv_id") % 4).alias("file"), "conv_id", "turn", row.alias("value"))
    rows.repartition(4, "file").sortWithinPartitions("file", "conv_id", "turn").select("file", "value").write.partitionBy("file").text(at)
    paths = sorted(mounted(f) for f in spark.read.text(at).inputFiles())
    if not paths:
        return c.limit(0).select(F.col("conv_id").alias("file"), *[F.col("turn").cast("int").alias(x) for x in ("number", "line")], "role", F.lit(0).alias("images"), F.col("text").alias("timestamp"), F.col("text").alias("digest"))
    m = read_log(spark, "\n".join(paths), "claude")
    return m.select(F.regexp_extract("source_file", "file=([0-9]+)", 1).cast("long").alias("file"), "number", "line", "role", "images", "timestamp", F.sha2("text", 256).alias("digest"))


@query(f"SELECT DISTINCT sha256(text) AS key, round((length(text) + 1) / sqrt((length(text) + 1)::DOUBLE * (length(text) + 1) + 1), 6) AS x, round(1 / sqrt((length(text) + 1)::DOUBLE * (length(text) + 1) + 1), 6) AS y FROM ({SQL_NOTES})")
def index_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of some notes, brought up to date with all: what was embedded stays, the rest is embedded, versions are swapped."""
    from tidepool.sources.files import scratch

    n = _notes(spark, sf_dir).select("doc_id", "path", F.sha2("text", 256).alias("fingerprint"), F.sha2("text", 256).alias("key"), F.col("text").alias("passage"))
    embed = lambda wanted: wanted.select("key", F.array(F.length("passage") + F.lit(1.0), F.lit(1.0)).alias("vector"))
    held = index.VectorIndex(spark, scratch(spark))
    for notes in (n.filter("doc_id % 3 = 0"), n):
        held.refresh(notes, notes, "p", embed)
    vectors, _, _ = held.read("p")
    return vectors.select("key", F.round(F.col("vector")[0], 6).alias("x"), F.round(F.col("vector")[1], 6).alias("y"))


@query("SELECT page_id, starts_with(p || '/', '/w/1/') AS within FROM (SELECT page_id, CASE page_id % 5 WHEN 3 THEN 'w/1' WHEN 4 THEN '/w/10' ELSE '/w/' || page_id % 3 || CASE WHEN page_id % 2 = 0 THEN '/' || page_id ELSE '' END END AS p FROM pages)")
def project_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepool.sources.sessions import inside

    i = F.col("page_id")
    own = F.concat(F.lit("/w/"), i % 3, F.when(i % 2 == 0, F.concat(F.lit("/"), i)).otherwise(F.lit("")))
    p = _t(spark, sf_dir, "pages").select("page_id", F.when(i % 5 == 3, F.lit("w/1")).when(i % 5 == 4, F.lit("/w/10")).otherwise(own).alias("p"))
    return p.select("page_id", inside("p", "/w/1").alias("within"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))


#: The passages of each note as DuckDB splits them: doc_id, c (which), start_line, end_line, text; blank ones are left out, but a note has one.
_CHUNKS = """WITH RECURSIVE l AS (SELECT doc_id, generate_subscripts(ls, 1) AS n, unnest(ls) AS s, len(ls) AS m FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM (NOTES))),
k AS (SELECT doc_id, n, CASE WHEN n < m THEN s || chr(10) ELSE s END AS s FROM l WHERE n < m OR s <> ''),
q AS (SELECT doc_id, n, unnest(range(0, greatest((length(s) + 1599) // 1600, 1))) AS o, s FROM k),
p AS (SELECT doc_id, n, substring(s, o * 1600 + 1, 1600) AS s, row_number() OVER (PARTITION BY doc_id ORDER BY n, o) AS i FROM q),
f AS (SELECT doc_id, i, length(s)::BIGINT AS size, 0::BIGINT AS c, FALSE AS carried FROM p WHERE i = 1
  UNION ALL SELECT p.doc_id, p.i, CASE WHEN f.size + length(p.s) > 1600 THEN length(p.s) + CASE WHEN length(b.s) < 200 THEN length(b.s) ELSE 0 END ELSE f.size + length(p.s) END,
    CASE WHEN f.size + length(p.s) > 1600 THEN f.c + 1 ELSE f.c END, f.size + length(p.s) > 1600 AND length(b.s) < 200
  FROM f JOIN p ON p.doc_id = f.doc_id AND p.i = f.i + 1 JOIN p b ON b.doc_id = f.doc_id AND b.i = f.i),
a AS (SELECT doc_id, c, i FROM f UNION ALL SELECT doc_id, c, i - 1 FROM f WHERE carried),
t AS (SELECT a.doc_id, a.c, min(p.n) AS start_line, max(p.n) AS end_line, string_agg(p.s, '' ORDER BY a.i) AS text FROM a JOIN p ON p.doc_id = a.doc_id AND p.i = a.i GROUP BY a.doc_id, a.c)
SELECT doc_id, c, start_line::INT AS start_line, end_line::INT AS end_line, text FROM t WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''
UNION ALL SELECT doc_id, 0, 1, 1, '' FROM (NOTES) WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) = ''"""
SQL_CHUNKS = _CHUNKS.replace("NOTES", SQL_NOTES)


@query(f"SELECT doc_id, start_line, end_line, sha256(text) AS digest FROM ({SQL_CHUNKS})")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunking.split_rows(_notes(spark, sf_dir), "doc_id", "text")
    return c.select("doc_id", "start_line", "end_line", F.sha2("text", 256).alias("digest"))


@query("SELECT conv_id, turn, 0 AS nth, 'https://x.example/' || turn || '.png' AS reference, 'a' AS alt, TRUE AS remote FROM conversations WHERE text IS NOT NULL")
def image_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References in Markdown that the conversations are given: outside code only."""
    from tidepool.operators.images import references

    c = _t(spark, sf_dir, "conversations").filter("text is not null")
    written = F.concat("text", F.lit("\n![a](https://x.example/"), F.col("turn"), F.lit(".png) `![b](no.png)`\n```\n![c](no.png)\n```\n"))
    return references(c.select("conv_id", "turn", written.alias("text")), ["conv_id", "turn"], "text")


@query("""WITH e AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn, role, text) AS line FROM conversations)
SELECT row_number() OVER (ORDER BY line) AS number, line, role, 0 AS images, text FROM e WHERE role IN ('user', 'assistant') AND coalesce(text, '') <> ''""")
def rotated_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as one log of many files, read back in byte ranges; numbers and lines go through the whole log."""
    from tidepool.sources.files import scratch
    from tidepool.sources.logs import log_messages

    at, c = scratch(spark), _t(spark, sf_dir, "conversations")
    order = ["conv_id", "turn", "role", "text"]
    row = F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", F.col("text").alias("content")).alias("message")))
    c.repartitionByRange(*order).sortWithinPartitions(*order).select(row.alias("value")).write.text(at)
    return log_messages(spark, at, "claude", rotated=True).select("number", "line", "role", "images", "text")


@query("""WITH c AS (SELECT *, coalesce(text, '') AS t FROM conversations WHERE role IN ('user', 'assistant'))
SELECT 'codex' AS client, conv_id, turn, role, 1 AS images, t || chr(10) || t AS text FROM c
UNION ALL SELECT 'claude', conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN 0 ELSE 2 END, t FROM c""")
def client_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as events of both clients: text in several parts, images among them, a plain string, a tool's result with JSON in a string."""
    from tidepool.sources.logs import events, images_within

    c = _t(spark, sf_dir, "conversations").filter("role in ('user', 'assistant')").withColumn("t", F.coalesce("text", F.lit("")))
    part = lambda kind, **more: F.struct(F.lit(kind).alias("type"), *[x.alias(k) for k, x in {"text": F.lit(None).cast("string"), "content": F.lit(None).cast("string"), **more}.items()])
    codex = F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct(F.lit("message").alias("type"), "role", F.array(part("input_text", text=F.col("t")), part("input_image"), part("reasoning", text=F.col("t")), part("output_text", text=F.col("t"))).alias("content")).alias("payload")))
    inside = F.lit('[{"type":"image"},{"type":"thinking","content":[{"type":"image"}]},"[{\\"type\\":\\"image_url\\"}]"]')
    listed = F.struct(F.array(part("text", text=F.col("t")), part("tool_result", content=inside)).alias("content"), "role")
    claude = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.col("role").alias("type"), F.struct(F.col("t").alias("content")).alias("message")))).otherwise(F.to_json(F.struct(F.col("role").alias("type"), listed.alias("message"))))
    out = []
    for client, value in (("codex", codex), ("claude", claude)):
        e = events(c.select("conv_id", "turn", value.alias("value")), client)
        images = F.col("images") + F.when(F.col("inner").isNotNull(), images_within("inner")).otherwise(0)
        out.append(e.select(F.lit(client).alias("client"), "conv_id", "turn", "role", images.alias("images"), "text"))
    return out[0].unionByName(out[1])


@query("""SELECT conv_id, turn, 0 AS nth, '{"source": "' || conv_id || '-' || turn || '", "type": "image"}' AS image FROM conversations
UNION ALL SELECT conv_id, turn, 1, '{"image_url": "u' || turn || '", "type": "input_image"}' FROM conversations""")
def result_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images in the results of tools as rows: at any depth, in strings of JSON, but not in reasoning."""
    from tidepool.sources.logs import events, image_rows

    source = F.concat_ws("-", "conv_id", "turn")
    text = F.to_json(F.array(F.struct(F.lit("input_image").alias("type"), F.concat(F.lit("u"), F.col("turn")).alias("image_url"))))
    shown = F.struct(F.lit("image").alias("type"), source.alias("source"), F.lit(None).cast("string").alias("content"))
    closed = F.struct(F.lit("reasoning").alias("type"), F.lit(None).cast("string").alias("source"), F.lit('[{"type":"image"}]').alias("content"))
    held = F.struct(F.lit("part").alias("type"), F.lit(None).cast("string").alias("source"), text.alias("content"))
    result = F.to_json(F.struct(F.array(shown, closed, held).alias("result")))
    row = F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct(F.lit("function_call_output").alias("type"), result.alias("output")).alias("payload")))
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", row.alias("value"))
    return image_rows(events(c, "codex"), "inner").select("conv_id", "turn", "nth", "image")


_FILES = """SELECT doc_id, coalesce(source, 'none') AS source, coalesce(text, '') AS text, CASE doc_id % 8 WHEN 1 THEN '.hidden/' WHEN 2 THEN 'x.assets/' WHEN 7 THEN 'Attachments/' ELSE coalesce(source, 'none') || '/' END
|| CASE WHEN doc_id % 8 = 4 THEN '.' ELSE '' END || doc_id || CASE doc_id % 8 WHEN 3 THEN '.MD' WHEN 5 THEN '.txt' ELSE '.md' END AS path,
CASE doc_id % 8 WHEN 0 THEN '---' || chr(10) || 'title: Note ' || doc_id || chr(10) || 'tags: [a, 7]' || chr(10) || 'status: active' || chr(10) || '---' || chr(10) WHEN 6 THEN '---' || chr(10) || 'title: x' || chr(10) ELSE '' END || coalesce(text, '') AS content FROM documents"""


@query(f"""WITH f AS (SELECT *, doc_id % 8 = 0 AS headed, doc_id % 8 IN (0, 3, 6) AS note FROM ({_FILES}))
SELECT path, CASE WHEN headed THEN 'Note ' || doc_id ELSE coalesce(nullif(trim(regexp_extract(text, '(?m)^#\\s+(.+)$', 1)), ''), doc_id::VARCHAR) END AS title, CASE WHEN headed THEN 'active' ELSE '' END AS status,
CASE WHEN headed THEN 'a,7' ELSE '' END AS tags, CASE WHEN headed THEN 6 ELSE 1 END AS first_line, sha256(content) AS fingerprint, NULL AS problem FROM f WHERE note AND strlen(content) <= 2000 AND doc_id % 8 <> 6
UNION ALL SELECT path, NULL, NULL, NULL, NULL, NULL, CASE WHEN strlen(content) > 2000 THEN 'larger than 2000 bytes' ELSE 'the front matter has no end' END FROM f WHERE note AND (strlen(content) > 2000 OR doc_id % 8 = 6)""")
def scanned_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a vault, some hidden, in folders left out, of other kinds, too large or broken: the notes, and what was put aside."""
    from tidepool.sources.notes import parsed

    d = _t(spark, sf_dir, "documents")
    i, source = F.col("doc_id") % 8, F.coalesce("source", F.lit("none"))
    folder = F.when(i == 1, F.lit(".hidden/")).when(i == 2, F.lit("x.assets/")).when(i == 7, F.lit("Attachments/")).otherwise(F.concat(source, F.lit("/")))
    path = F.concat(folder, F.when(i == 4, F.lit(".")).otherwise(F.lit("")), "doc_id", F.when(i == 3, F.lit(".MD")).when(i == 5, F.lit(".txt")).otherwise(F.lit(".md")))
    front = F.when(i == 0, F.concat(F.lit("---\ntitle: Note "), "doc_id", F.lit("\ntags: [a, 7]\nstatus: active\n---\n"))).when(i == 6, F.lit("---\ntitle: x\n")).otherwise(F.lit(""))
    content = F.concat(front, F.coalesce("text", F.lit(""))).cast("binary")
    files = d.select(path.alias("path"), F.concat(F.lit("/"), path).alias("absolute"), F.octet_length(content).cast("long").alias("length"), content.alias("content"))
    notes, skipped = parsed(files, max_bytes=2000)
    seen = notes.select("path", "title", "status", F.array_join("tags", ",").alias("tags"), "first_line", "fingerprint", F.lit(None).cast("string").alias("problem"))
    return seen.unionByName(skipped.select("path", F.col("message").alias("problem")), allowMissingColumns=True)


@query(f"SELECT path, sha256(text) AS fingerprint FROM ({SQL_NOTES}) WHERE doc_id % 3 <> 0 AND doc_id % 7 <> 0")
def fresh_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All notes against what is there now: a third of them was changed, one in seven is gone."""
    from tidepool.plans.search import fresh

    n = _notes(spark, sf_dir)
    now = n.filter("doc_id % 7 <> 0").select("path", X.fingerprint(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("fingerprint"))
    return fresh(n.select("path", X.fingerprint(F.col("text")).alias("fingerprint")), now)


def vault_rows(documents: DataFrame) -> DataFrame:
    """documents as the notes of a vault, with every property that a search looks at: each copy of a text is superseded by the next
    one, two notes in three belong to every project, and the others to that of their source. A # is written ♯, as prose has no headings.
    """
    from pyspark.sql import Window

    source = F.coalesce("source", F.lit("none"))
    n = documents.select("doc_id", source.alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), F.translate(F.coalesce("text", F.lit("")), "#", "♯").alias("body"), F.col("doc_id").cast("string").alias("stem"), F.concat(source, F.lit("/"), "doc_id", F.lit(".md")).alias("path"))
    n = n.withColumn("fingerprint", X.fingerprint(F.col("body")))
    links = n.select("doc_id", F.lead("path").over(Window.partitionBy("fingerprint").orderBy("doc_id")).alias("next"))
    n = n.join(links, "doc_id")
    text, none = F.lit(""), F.array().cast("array<string>")
    project = F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(F.lit("global"))
    return n.select(
        "path", F.concat(F.lit("/"), "path").alias("absolute"), "stem", F.col("stem").alias("title"), "fingerprint", F.lit("{}").alias("meta"), F.lit("lesson").alias("kind"),
        F.when(F.col("next").isNotNull(), F.lit("superseded")).otherwise(F.lit("active")).alias("status"), project.alias("project"), text.alias("module"), text.alias("description"), none.alias("aliases"),
        F.array("lang").alias("tags"), none.alias("sources"), none.alias("path_globs"), F.when(F.col("next").isNotNull(), F.array(F.concat(F.lit("[["), "next", F.lit("]]")))).otherwise(none).alias("superseded_by"),
        X.header(title=F.col("stem"), filename=F.col("stem"), tags=F.col("lang"), project=project).alias("header"), "body", F.lit(1).alias("first_line"),
    )


_PROSE = "translate(coalesce(text, ''), '#', '♯')"
_VAULT = f"""SELECT doc_id, coalesce(source, 'none') || '/' || doc_id || '.md' AS path, doc_id::VARCHAR AS stem, coalesce(lang, '') AS lang, {_PROSE} AS text,
lead(doc_id) OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) AS nxt, CASE WHEN doc_id % 3 = 0 THEN coalesce(source, 'none') ELSE 'global' END AS project FROM documents"""
_VAULT_PASSAGE = "concat_ws(chr(10), 'Title: ' || stem, 'Filename: ' || stem, CASE WHEN lang <> '' THEN 'Tags: ' || lang END, 'Project: ' || project) || chr(10) || 'Section: ' || chr(10) || CASE WHEN c.text <> '' THEN chr(10) || c.text ELSE '' END || chr(10) || stem || ' ' || stem || ' ' || lang || chr(10) || stem || ' ' || stem || ' ' || lang"


@query(f"""WITH RECURSIVE v AS ({_VAULT}), scope AS (SELECT * FROM v WHERE project IN ('src0', 'global')), c AS (SELECT doc_id, c, start_line, text FROM ({_CHUNKS.replace("NOTES", "SELECT doc_id, text FROM v")})),
hit AS (WITH {sql_bm25(f"SELECT scope.doc_id, c.c, {sql_tokens(_VAULT_PASSAGE)} AS tok FROM scope JOIN c ON c.doc_id = scope.doc_id", _QT)} SELECT doc_id, c, score FROM s),
b AS (SELECT doc_id, c, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, c) AS k FROM hit) WHERE k = 1),
w AS (SELECT doc_id AS node, doc_id AS pos, [v.path]::VARCHAR[] AS seen FROM v UNION ALL SELECT w.node, x.nxt, list_append(seen, y.path) FROM w JOIN v x ON x.doc_id = w.pos JOIN v y ON y.doc_id = x.nxt),
z AS (SELECT node, arg_max(pos, len(seen)) AS target, arg_max(seen, len(seen)) AS seen FROM w GROUP BY node),
r AS (SELECT z.target, b.doc_id AS source, v.path AS source_path, b.c, b.score, CASE WHEN z.target <> b.doc_id THEN array_to_string(seen[:len(seen) - 1], '>') END AS chain FROM b JOIN z ON z.node = b.doc_id JOIN v ON v.doc_id = b.doc_id WHERE z.target IN (SELECT doc_id FROM scope)),
g AS (SELECT target, arg_min(source, (-score, source_path)) AS source, arg_min(c, (-score, source_path)) AS c, max(score) AS score, coalesce(string_agg(chain, '|' ORDER BY score DESC, source_path), '') AS chains FROM r GROUP BY target),
o AS (SELECT c.*, row_number() OVER (PARTITION BY doc_id ORDER BY c) AS k FROM c),
n AS (SELECT g.target, string_agg(o.start_line::VARCHAR, ',' ORDER BY o.c) AS lines FROM g JOIN o ON o.doc_id = g.target AND (CASE WHEN g.source = g.target THEN o.c = g.c ELSE o.k <= 2 END) GROUP BY g.target)
SELECT v.path, round(g.score, 6) AS score, g.chains, n.lines FROM g JOIN v ON v.doc_id = g.target JOIN n ON n.target = g.target ORDER BY g.score DESC, v.path LIMIT 20""")
def recall_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search: a recall in a project over all notes, where superseded wordings lead to their replacements in scope, with snippets of these."""
    from tidepool.plans.search import Corpus, Request, found

    notes = vault_rows(_t(spark, sf_dir, "documents"))
    corpus = Corpus.of(notes, notes.select(F.lit("").alias("code"), F.lit("").alias("message"), "path").limit(0), lambda asked: notes.join(asked.select("path"), "path", "left_semi").select("path", "fingerprint"))
    try:
        out = found(corpus, Request(SEARCH, "fts", 20, recall=True, project="src0"))
    finally:
        corpus.release()
    rows = [(r["path"], r["score"], "|".join(">".join(c) for c in r["replacement_chains"]), ",".join(str(s["start_line"]) for s in r["snippets"])) for r in out["results"]]
    return spark.createDataFrame(rows, "path string, score double, chains string, lines string")
