"""One query per operator of this package, over its whole table with production parameters, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscore.llm import (
    ann,
    decontaminate,
    exact_dedup,
    hard_negatives,
    licenses,
    line_dedup,
    ngram_join,
    pii,
    secrets,
    sentence_pieces,
    token_counts,
    toxicity,
    whitening,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MAX_TOKENS = 4096


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    """The SentencePiece vocabulary that the box offers; operators take its path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op4_line_dedup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    kept = line_dedup.drop_shared_lines(docs, n_lines="n_lines", n_dropped="n_dropped")
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_SPACE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
# The part that the pipeline shares: lines of a view `docs(doc_id, text)` with `dropped` marked.
LINES_SQL = f"""
lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM docs
), keyed AS (
    SELECT *, translate(trim(line, {_SPACE_SQL}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), shared AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= {line_dedup.MIN_CHARS}
    GROUP BY key HAVING count(DISTINCT doc_id) >= {line_dedup.MIN_DOCS}
), marked AS (
    SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.keeper AS dropped
    FROM keyed k LEFT JOIN shared s USING (key)
)"""
ORACLES["op4_line_dedup"] = f"""
WITH docs AS (SELECT doc_id, text FROM documents), {LINES_SQL}
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op6_token_counts(spark, d):
    return token_counts.count_tokens(table(spark, d, "documents"), piece_model(), MAX_TOKENS)


# In production the key comes from the caller's secret store; results depend on it and on nothing else.
PII_KEY = b"op1 example key"


@query
def op1_pii(spark, d):
    return pii.pseudonymise(table(spark, d, "documents"), PII_KEY)


@query
def op3_secret_scan(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs, secrets.train(docs))
    digest = F.sha2("base_spans", 256).alias("base_sha256")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", digest, "spans")


@query
def op5_nearest_neighbours(spark, d):
    return ann.search(table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op7_decontamination(spark, d):
    return decontaminate.find_leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query
def op8_toxicity(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, d, "labels"), ~held_out))
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted)


@query
def op10_license_scan(spark, d):
    # The table has no paths. A source is taken for a repository with a folder per 1,000 ids and one per 50 in it.
    folder = F.concat_ws("/", "source", F.format_string("part%d", F.expr("doc_id div 1000")), F.format_string("box%d", F.expr("doc_id div 50")))
    docs = table(spark, d, "documents")
    found = licenses.scan(docs, F.concat_ws("/", folder, F.format_string("%d.txt", "doc_id")), file_share=0.2)
    return found.withColumn("cosine", F.round("cosine", 6))


@query
def op2_ngram_jaccard(spark, d):
    return ngram_join.join(table(spark, d, "documents"))


@query
def op9_sentence_pieces(spark, d):
    encoded = sentence_pieces.encode(table(spark, d, "documents"), piece_model())
    read = sentence_pieces.decode(encoded, piece_model())
    return read.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


# Words as the operators take them: lower-case runs of ASCII letters and digits and of all that is beyond ASCII.
def _words_sql(text: str) -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"


_SIZE, _LIKE = ngram_join.SHINGLE_WORDS, ngram_join.THRESHOLD
ORACLES["op2_ngram_jaccard"] = f"""
WITH RECURSIVE texts AS (SELECT doc_id, {_words_sql("text")} AS words FROM documents),
sets AS (
    SELECT doc_id, list_sort(list_distinct(list_transform(range(1, len(words) - least(len(words), {_SIZE}) + 2),
           lambda i: array_to_string(words[i : i + {_SIZE} - 1], ' ')))) AS grams
    FROM texts WHERE len(words) > 0
), nodes AS (
    SELECT grams, min(doc_id) AS node, count(*) AS n_copies FROM sets GROUP BY grams
), entries AS (
    SELECT node, len(grams) AS n, unnest(grams) AS gram FROM nodes
), common AS (
    SELECT a.node AS a, b.node AS b, a.n + b.n - count(*) AS n_union, count(*) AS n_common
    FROM entries a JOIN entries b ON a.gram = b.gram AND a.node <> b.node GROUP BY a.node, b.node, a.n, b.n
), links AS (
    SELECT a, b FROM common WHERE n_common >= {_LIKE} * n_union
), reached(node, other) AS (
    SELECT node, node FROM nodes UNION SELECT r.node, l.b FROM reached r JOIN links l ON r.other = l.a
), classes AS (
    SELECT node, min(other) AS class_id FROM reached GROUP BY node
), degrees AS (
    SELECT a AS node, count(*) AS n_links FROM links GROUP BY a
)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0) AS n_links, coalesce(n_copies, 1) AS n_copies
FROM documents LEFT JOIN sets USING (doc_id) LEFT JOIN nodes USING (grams) LEFT JOIN classes USING (node) LEFT JOIN degrees USING (node)
"""

_STRETCH, _AGREE = decontaminate.STRETCH, decontaminate.AGREE
ORACLES["op7_decontamination"] = f"""
WITH doc_words AS (SELECT doc_id, {_words_sql("text")} AS words FROM documents),
item_words AS (SELECT item_id, {_words_sql("text")} AS words FROM benchmark),
doc_at AS (SELECT doc_id, len(words) AS n_doc, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS p FROM doc_words),
item_at AS (
    SELECT item_id, len(words) AS n_words, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS p FROM item_words
    WHERE len(words) >= {decontaminate.MIN_ITEM}
), alignments AS (
    SELECT doc_id, item_id, d.p - i.p AS shift, n_doc, n_words, least(n_words, {_STRETCH}) AS size, list(i.p) AS same
    FROM doc_at d JOIN item_at i USING (word) GROUP BY ALL HAVING count(*) >= {_AGREE} * least(n_words, {_STRETCH})
), stretches AS (
    SELECT *, unnest(range(greatest(0, -shift), least(n_words, n_doc - shift) - size + 1)) AS a FROM alignments
), agreeing AS (
    SELECT doc_id, item_id, shift, n_words, size, list_filter(same, lambda x: x >= a AND x < a + size) AS inside FROM stretches
), covered AS (
    SELECT DISTINCT doc_id, item_id, shift, n_words, unnest(inside) AS p FROM agreeing WHERE len(inside) >= {_AGREE} * size
), counted AS (
    SELECT doc_id, item_id, shift, n_words, count(*) AS n_agree FROM covered GROUP BY ALL
)
SELECT doc_id, item_id, max(n_agree) AS n_agree, n_words FROM counted GROUP BY doc_id, item_id, n_words
"""

_TEMPLATES_SQL = ", ".join(
    f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate((n, t) for n, texts in licenses.TEMPLATES.items() for t in texts)
)
_TERMS_SQL = "regexp_extract_all(lower({}), '[a-z0-9]+(?:\\.[0-9]+)*')"
_WORD_COUNT_SQL = "len(string_split_regex(trim({}), '\\s+'))"
_VECTOR_SQL = """
    SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS w FROM (
        SELECT {key}, term, count(*) * any_value(idf) * {decisive} AS w FROM (SELECT {key}, unnest(terms) AS term FROM {source}) JOIN idf USING (term)
        GROUP BY {key}, term)"""
_DECISIVE_SQL = f"CASE WHEN term IN ({', '.join(repr(t) for t in licenses.DECISIVE)}) THEN {licenses.DECISIVE_WEIGHT} ELSE 1 END"
_N_WORDS_SQL = "len(string_split(trim({}), ' '))"
_WINDOWS_SQL = f"""[''] || flatten(list_transform(list_filter(range(1, {_N_WORDS_SQL.format("s")} + 1),
           lambda i: regexp_matches(string_split(trim(s), ' ')[i], '{licenses._CUE_WORD}')),
           lambda i: [array_to_string(string_split(trim(s), ' ')[greatest(i - {licenses.WORDS_BEFORE}, 1) : i + {licenses.WORDS_AFTER}], ' '), '']))"""
_PIECES_SQL = f"""CASE WHEN {_N_WORDS_SQL.format("l")} <= {licenses.LONG_LINE} THEN [l] ELSE flatten(list_transform(
           string_split(regexp_replace(l, '{licenses._SENTENCE_END}', '\\1' || chr(10), 'g'), chr(10)),
           lambda s: CASE WHEN {_N_WORDS_SQL.format("s")} <= {licenses.LONG_LINE} THEN [s] ELSE {_WINDOWS_SQL} END)) END"""
ORACLES["op10_license_scan"] = f"""
WITH files AS (
    SELECT doc_id, source || '/part' || (doc_id // 1000) || '/box' || (doc_id // 50) AS dir, coalesce(text, '') AS text FROM documents
), pieces AS (
    SELECT doc_id, text, list_filter(flatten(list_transform(string_split(text, chr(10)), lambda l: {_PIECES_SQL})),
           lambda l: NOT regexp_matches(l, '{licenses._MARKS_ONLY}')) AS pieces
    FROM files WHERE regexp_matches(text, '{licenses._CUE}')
), runs AS (
    SELECT doc_id, text, regexp_replace(trim(array_to_string(list_transform(
           pieces, lambda l: CASE WHEN regexp_matches(l, '{licenses._CUE}') THEN trim(l) ELSE '' END), chr(10)), chr(10)),
           '\\n{{2,}}', chr(10) || chr(10), 'g') AS runs
    FROM pieces
), noted AS (
    SELECT doc_id, share, CASE WHEN share >= 0.2 THEN concat_ws(chr(10) || chr(10), nullif(runs, ''), regexp_replace(trim(text), '\\s+', ' ', 'g'))
                               ELSE nullif(runs, '') END AS header
    FROM (SELECT *, least({_WORD_COUNT_SQL.format("runs")} / {_WORD_COUNT_SQL.format("text")}, 1.0) AS share FROM runs)
), parted AS (
    SELECT header AS headers, n, unnest(list_distinct(string_split(header, chr(10) || chr(10)))) AS header
    FROM (SELECT header, count(*) AS n FROM noted WHERE header IS NOT NULL GROUP BY header)
), headers AS (
    SELECT header, sum(n) AS n_files, {_TERMS_SQL.format("header")} AS terms FROM parted GROUP BY header
), templates AS (
    SELECT template_id, license, {_TERMS_SQL.format("text")} AS terms FROM (VALUES {_TEMPLATES_SQL}) t(template_id, license, text)
), counted AS (
    SELECT n_files, unnest(list_distinct(terms)) AS term FROM headers WHERE len(terms) > 0
    UNION ALL SELECT 1, unnest(list_distinct(terms)) FROM templates
), total AS (
    SELECT (SELECT coalesce(sum(n_files), 0) FROM headers WHERE len(terms) > 0) + (SELECT count(*) FROM templates) AS n
), idf AS (
    SELECT term, ln((1 + any_value(n)) / (1 + sum(n_files))) + 1 AS idf FROM counted, total GROUP BY term
), ours AS ({_VECTOR_SQL.format(key="header", source="headers", decisive=_DECISIVE_SQL)}
), theirs AS ({_VECTOR_SQL.format(key="template_id", source="templates", decisive=_DECISIVE_SQL)}
), cosines AS (
    SELECT header, license, round(sum(o.w * t.w), 9) AS cosine FROM ours o JOIN theirs t USING (term) JOIN templates USING (template_id)
    GROUP BY header, template_id, license
), best AS (
    SELECT headers, min(license) AS license, any_value(cosine) AS cosine
    FROM (SELECT headers, license, cosine, rank() OVER (PARTITION BY headers ORDER BY cosine DESC) AS r FROM parted JOIN cosines USING (header))
    WHERE r = 1 GROUP BY headers
), judged AS (
    SELECT f.doc_id, f.dir, CASE WHEN cosine >= {licenses.MIN_COSINE} THEN license END AS license, cosine,
           coalesce(n.share, 0) >= 0.2 AS is_file
    FROM files f LEFT JOIN noted n USING (doc_id) LEFT JOIN best b ON n.header = b.headers
), grants AS (
    SELECT dir AS above, license FROM judged WHERE is_file AND license IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, license) = 1
), nearest AS (
    SELECT d.dir, arg_max(g.above, length(g.above)) AS above, arg_max(g.license, length(g.above)) AS license
    FROM (SELECT DISTINCT dir FROM files) d JOIN grants g ON d.dir = g.above OR starts_with(d.dir, g.above || '/') GROUP BY d.dir
)
SELECT doc_id, j.dir || '/' || doc_id || '.txt' AS path, coalesce(j.license, n.license) AS license,
       CASE WHEN j.license IS NOT NULL THEN CASE WHEN is_file THEN 'file' ELSE 'header' END
            WHEN n.above IS NOT NULL THEN 'directory' ELSE 'none' END AS origin,
       CASE WHEN j.license IS NULL THEN n.above END AS inherited_from, round(cosine, 6) AS cosine
FROM judged j LEFT JOIN nearest n USING (dir)
"""


@query
def op11_hard_negatives(spark, d):
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(table(spark, d, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


ORACLES["op11_hard_negatives"] = """
WITH part AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scores AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
    FROM part a JOIN part b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), ranked AS (
    SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER)
           AS rank, other_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scores USING (anchor_id)
    WHERE NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT * FROM ranked WHERE rank <= 5
"""


@query
def op12_embedding_whitening(spark, d):
    rows = whitening.whitened_components(table(spark, d, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


@query
def op13_exact_dedup(spark, d):
    return exact_dedup.group_copies(table(spark, d, "documents"))


ORACLES["op13_exact_dedup"] = """
WITH plain AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
       sha256(text) AS text_sha256
FROM plain WINDOW same AS (PARTITION BY text)
"""
