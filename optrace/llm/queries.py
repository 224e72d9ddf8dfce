"""The operators over their whole tables: name -> function of (spark, folder), and their SQL."""

from pyspark.sql import functions as F

from optrace.llm import alignment, bpe, html_text, jaccard, licenses, line_dedup, packing, phrases, quality, suffixes, token_counts, topk, toxicity
from optrace.llm.common import shared_folder, staged, table


def op1_topk_search(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", topk.quantised(F.col("embedding")).alias("vector"))
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0)


def op2_packing(spark, sf):
    return packing.packed(table(spark, sf, "documents"))


def op3_token_counts(spark, sf):
    """All documents are counted in words; toxic ones are then withdrawn, and those that are not
    English counted anew in pieces. The first batch comes twice, as after a retry."""
    counts = token_counts.counted(F.col("text"), "words-1").alias("words"), token_counts.counted(F.col("text"), "pieces-1").alias("pieces")
    # Texts are read and counted once; only counts are joined.
    ledger = staged(table(spark, sf, "documents").select("doc_id", "source", "lang", *counts), "ledger")
    toxic = table(spark, sf, "labels").filter("toxic = 1").select("doc_id").distinct()
    withdrawn, other = ledger.join(toxic, "doc_id", "left_semi"), ledger.filter("lang <> 'en'").join(toxic, "doc_id", "left_anti")

    def under(rows, version, column):
        return rows.select("source", "lang", F.lit(version).alias("version"), F.col(column).alias("n_tokens"))

    rollup = token_counts.Rollup(spark, shared_folder(spark, "rollup"))
    load = token_counts.inserts(under(ledger, "words-1", "words"))
    rollup.commit("load", load)
    rollup.commit("withdraw", token_counts.deletes(under(withdrawn, "words-1", "words")))
    rollup.commit("recount", token_counts.revisions(under(other, "words-1", "words"), under(other, "pieces-1", "pieces")))
    rollup.commit("load", load)
    return rollup.totals()


def op4_quality_rules(spark, sf):
    documents = table(spark, sf, "documents")
    model = quality.train(documents, table(spark, sf, "labels"))
    found = quality.quality_verdicts(documents.select("doc_id", "text"), model)
    return found.drop("text")


def op5_html_extraction(spark, sf):
    return html_text.page_texts(table(spark, sf, "pages"))


def op6_line_dedup(spark, sf):
    found = line_dedup.drop_boilerplate(table(spark, sf, "documents").select("doc_id", "source", "text"))
    return found.select("doc_id", "text", "n_dropped")


def op7_bpe(spark, sf):
    return bpe.encoding_digests(table(spark, sf, "documents"))


def op8_toxicity(spark, sf):
    documents = table(spark, sf, "documents")
    machine = toxicity.train(documents, table(spark, sf, "labels"))
    found = toxicity.toxicity_scores(documents.select("doc_id", "text"), machine)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_license_scan(spark, sf):
    return licenses.license_scan(table(spark, sf, "documents"), licenses.known_digests(spark))


def op9_license_passages(spark, sf):
    return licenses.license_passages(table(spark, sf, "documents"), licenses.known_digests(spark))


def op10_jaccard_join(spark, sf):
    return jaccard.jaccard_components(table(spark, sf, "documents"))


def op11_phrase_collocations(spark, sf):
    return phrases.collocations(table(spark, sf, "documents"))


def op12_alignment(spark, sf):
    return alignment.alignments(table(spark, sf, "documents"))


def op13_repeated_passages(spark, sf):
    return suffixes.without_repeats(table(spark, sf, "documents")).drop("spans")


QUERIES = {
    f.__name__: f
    for f in (op1_topk_search, op2_packing, op3_token_counts, op4_quality_rules, op5_html_extraction, op6_line_dedup, op7_bpe,
              op8_toxicity, op9_license_scan, op9_license_passages, op10_jaccard_join, op11_phrase_collocations, op12_alignment, op13_repeated_passages)
}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _canonical(column: str) -> str:
    out = f"lower({column})"
    for pattern, replacement in licenses.RULES:
        out = f"regexp_replace({out}, {_text(pattern)}, {_text(replacement)}, 'g')"
    return f"trim({out})"


def _known() -> str:
    rows = ", ".join(f"({_text(name)}, {_text(text)})" for name, texts in licenses.KNOWN.items() for text in texts)
    return f"SELECT sha256({_canonical('text')}) AS digest, min(name) AS license FROM (VALUES {rows}) AS k(name, text) GROUP BY 1"


def _counted(version: str) -> str:
    return f"len(regexp_extract_all(coalesce(text, ''), {_text(token_counts.PATTERNS[version])}))"


def boilerplate_sql(documents: str, ratio: float = line_dedup.RATIO, least: int = line_dedup.LEAST_PAGES) -> str:
    """SELECT of the columns of documents, text without boilerplate lines, and n_dropped."""
    return f"""
    WITH docs AS (SELECT *, row_number() OVER () AS row_no FROM {documents}),
    pages AS (SELECT DISTINCT source, text FROM docs WHERE source IS NOT NULL AND text IS NOT NULL),
    totals AS (SELECT source, count(*) AS n FROM pages GROUP BY source),
    held AS (SELECT source, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM pages),
    common AS (
        SELECT held.source, line FROM held JOIN totals ON held.source = totals.source WHERE line <> ''
        GROUP BY held.source, line, n HAVING count(*) >= {least} AND count(*) > {ratio} * n),
    lists AS (SELECT source, list(line) AS lines FROM common GROUP BY source)
    SELECT docs.* EXCLUDE (row_no, text),
        CASE WHEN lines IS NULL OR text IS NULL THEN text
             ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(lines, x)), chr(10)) END AS text,
        CASE WHEN lines IS NULL OR text IS NULL THEN 0
             ELSE len(list_filter(string_split(text, chr(10)), lambda x: list_contains(lines, x))) END AS n_dropped
    FROM docs LEFT JOIN lists ON docs.source = lists.source"""


def collocations_sql(documents: str, longest: int = phrases.LONGEST, least: int = phrases.LEAST, top: int = phrases.TOP, inside: int = phrases.INSIDE) -> str:
    """The top phrases of each language of documents, phrases held as texts."""
    upper = "".join(chr(c) for c in range(65, 91))
    return f"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'),
            '[.,;:!?\\x0A-\\x0D]')) AS piece FROM {documents}),
    lists AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM pieces),
    held AS (
        SELECT lang, size, unnest(list_transform(range(1, len(words) - size + 2), lambda i: array_to_string(words[i:i + size - 1], ' '))) AS phrase
        FROM lists, range(1, {longest + 1}) AS sizes(size)),
    totals AS (SELECT lang, count(*) AS n FROM held WHERE size = 1 GROUP BY lang),
    counts AS (SELECT lang, size, phrase, count(*) AS a FROM held GROUP BY lang, size, phrase HAVING count(*) >= {least}),
    candidates AS (SELECT *, string_split(phrase, ' ') AS words FROM counts WHERE size >= 2),
    parts AS (
        SELECT lang, a, unnest(flatten(list_transform(range(2, size), lambda s:
            list_transform(range(1, size - s + 2), lambda i: array_to_string(words[i:i + s - 1], ' '))))) AS phrase FROM candidates),
    within AS (SELECT lang, phrase, max(a) AS longer FROM parts GROUP BY lang, phrase),
    kept AS (
        SELECT c.* FROM candidates AS c LEFT JOIN within AS w ON c.lang = w.lang AND c.phrase = w.phrase
        WHERE longer IS NULL OR 100 * longer < {inside} * a),
    cuts AS (
        SELECT kept.lang, kept.phrase, kept.a, k, one.a AS l, two.a AS r,
            CAST(CAST(1000000 AS HUGEINT) * kept.a * kept.a // (CAST(one.a AS HUGEINT) * two.a) AS BIGINT) AS score
        FROM (SELECT *, unnest(range(1, size)) AS k FROM kept) AS kept
        JOIN counts AS one ON kept.lang = one.lang AND one.phrase = array_to_string(words[1:k], ' ')
        JOIN counts AS two ON kept.lang = two.lang AND two.phrase = array_to_string(words[k + 1:], ' ')),
    lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
    SELECT lowest.lang, row_number() OVER (PARTITION BY lowest.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM lowest JOIN totals ON lowest.lang = totals.lang QUALIFY rank <= {top}"""


ORACLES = {
    "op1_topk_search": """
    WITH v AS (
        SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS vector
        FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    s AS (
        SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.vector, v.vector) AS BIGINT) AS score
        FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM s QUALIFY rank <= 20""",
    "op3_token_counts": f"""
    WITH toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
    kept AS (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM toxic)),
    counts AS (
        SELECT source, lang, 'words-1' AS version, {_counted('words-1')} AS n FROM kept WHERE NOT coalesce(lang <> 'en', false)
        UNION ALL
        SELECT source, lang, 'pieces-1', {_counted('pieces-1')} FROM kept WHERE lang <> 'en')
    SELECT source, lang, version, count(*) AS documents, CAST(sum(n) AS BIGINT) AS tokens FROM counts GROUP BY ALL""",
    "op6_line_dedup": f"SELECT doc_id, text, n_dropped FROM ({boilerplate_sql('documents')})",
    "op11_phrase_collocations": collocations_sql("documents"),
    "op9_license_scan": f"""
    WITH known AS ({_known()}), found AS (SELECT doc_id, {_canonical('text')} AS text FROM documents)
    SELECT doc_id, sha256(text) AS digest, CASE WHEN text <> '' THEN license END AS license
    FROM found LEFT JOIN known ON sha256(text) = known.digest""",
}
