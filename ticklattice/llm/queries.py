"""One query per operator over its whole table, and SQL statements where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklattice.llm.common import LOWER, UPPER, table
from ticklattice.llm.decontamination import contamination
from ticklattice.llm.exact_dedup import exact_duplicates
from ticklattice.llm.filter_audit import filter_interactions
from ticklattice.llm.html_extract import extract
from ticklattice.llm.jaccard_join import similar_documents
from ticklattice.llm.language_model import score_texts
from ticklattice.llm.license_scan import COPYRIGHT_LINE, KNOWN, OTHER_SPELLINGS, PUNCTUATION, SPELLINGS, known_digests, license_scan
from ticklattice.llm.merkle import fold, leaf_digest, manifest, proof_digest
from ticklattice.llm.packing import byte_encoder, pack
from ticklattice.llm.piece_codec import encode, model_bytes
from ticklattice.llm.sharding import shards
from ticklattice.llm.toxicity import severity, train
from ticklattice.llm.url_filter import url_filter, url_parts

N_SHARDS = 24
#: (verdict, host, path)
URL_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: What a document's leaf in the manifest is made of.
LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), span=10)
    digest = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), modulus=10)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return severity(docs, train(docs, table(spark, sf_dir, "labels")))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"), known_digests(spark))
    return found.withColumn("line_licenses", F.array_join("line_licenses", ","))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number in a url's path is the document the page shows, whose labels make the url a good or a bad example."""
    pages = table(spark, sf_dir, "pages")
    number = F.regexp_extract(url_parts(F.col("url"))[1], r"/(\d{1,18})", 1).try_cast("bigint")
    bad = (F.max("toxic") == 1) | (F.min("quality") == 0)
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.when(bad, "block").otherwise("allow").alias("verdict"))
    labelled = pages.select("url", number.alias("doc_id")).join(marks, "doc_id").select("url", "verdict")
    return url_filter(pages, labelled, URL_RULES)


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"), shingle=3, percent=90)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = encode(docs, model_bytes(TOKENIZER), check_col="decodes_back")
    return tokens.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "decodes_back")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"), N_SHARDS)


def corpus_filters(text: Column) -> dict[str, Column]:
    """Conditions of failure: short, repetitive, loud, or with signs of code and markup."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, r"[ \x09-\x0D]+"), "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = filter_interactions(docs, table(spark, sf_dir, "labels"), corpus_filters(F.col("text")), copies="E")
    return found.drop("filter")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), lambda: byte_encoder(BYTE_TOKENIZER), end_id=1, window=2048)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 3 divides an identifier's CRC-32 the text was tampered with: its capitals are small."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    text = F.when(tampered, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    rows = manifest(docs, fields=LEAF, claimed=leaf_digest([*map(F.col, LEAF[:-1]), text]))
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), fold(F.col("claimed"), F.col("proof")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_lm_scoring,
        op3_toxicity,
        op4_html_extraction,
        op5_license_scans,
        op6_url_filters,
        op7_ngram_jaccard_join,
        op8_exact_dedup,
        op9_sentencepiece,
        op10_sharding,
        op11_filter_audit,
        op12_packing,
        op13_merkle_manifest,
    )
}



def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    """The canonical lines of a text as a list."""
    words = f"regexp_replace(x, {_quoted(PUNCTUATION)}, ' ', 'g')"
    spelled = words
    for other, one in SPELLINGS:
        spelled = rf"regexp_replace({spelled}, '\b{other}\b', '{one}', 'g')"
    kept = f"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '\r\n|\n|\r'), lambda x: NOT regexp_matches(x, {_quoted(COPYRIGHT_LINE)}))"
    return f"list_transform({kept}, lambda x: trim(CASE WHEN regexp_matches({words}, {_quoted(OTHER_SPELLINGS)}) THEN {spelled} ELSE {words} END))"


_WHOLE_SQL = "array_to_string(list_filter(lines, lambda x: x <> ''), ' ')"
_LICENSES_SQL = f"""
    WITH known AS (SELECT min(license) AS license, {_WHOLE_SQL} AS form FROM (
        SELECT license, {_canonical_sql('body')} AS lines FROM (VALUES {', '.join(f'({_quoted(i)}, {_quoted(t)})' for i, t in KNOWN)}) v(license, body)) GROUP BY form),
    docs AS (SELECT doc_id, {_canonical_sql('text')} AS lines FROM documents),
    found AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses, count(*) AS n_line_licenses
              FROM (SELECT doc_id, unnest(lines) AS form FROM docs) JOIN known USING (form) GROUP BY doc_id)
    SELECT doc_id, k.license AS text_license, coalesce(line_licenses, '') AS line_licenses, coalesce(n_line_licenses, 0) AS n_line_licenses,
           sha256({_WHOLE_SQL}) AS text_digest
    FROM docs LEFT JOIN known k ON k.form = {_WHOLE_SQL} LEFT JOIN found USING (doc_id)"""

_FRAMED = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END" for c in LEAF)
_TAMPERED = _FRAMED.replace("text::VARCHAR", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")


def _tree_sql(name: str, leaves: str) -> str:
    """Nodes of the trees over ``leaves(key, pos, n, h)`` with what stands before and after each in its run of eight."""
    return f"""
    {name}_nodes AS (
        SELECT key, 0 AS level, pos, n, h FROM {leaves}
        UNION ALL
        SELECT key, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM {name}_nodes WHERE n > 1 GROUP BY key, level, n, pos // 8),
    {name}_runs AS (
        SELECT key, level, pos, n, h,
               coalesce(string_agg(h, '') OVER (PARTITION BY key, level, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
               coalesce(string_agg(h, '') OVER (PARTITION BY key, level, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
        FROM {name}_nodes)"""


# CRC-32 of a decimal number bit by bit; trees level by level; each leaf's way up its group's tree and then the tree of the groups.
_MANIFEST_SQL = f"""
    WITH RECURSIVE crcs(doc_id, s, place, c) AS (
        SELECT DISTINCT doc_id, doc_id::VARCHAR, 0, 4294967295::BIGINT FROM documents
        UNION ALL
        SELECT doc_id, s, place + 1, CASE WHEN place % 9 = 0 THEN xor(c, ascii(s[place // 9 + 1])::BIGINT) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END
        FROM crcs WHERE place < 9 * length(s)),
    marks AS (SELECT doc_id, xor(c, 4294967295::BIGINT) % 3 = 0 AS tampered FROM crcs WHERE place = 9 * length(s)),
    digests AS (
        SELECT d.doc_id, coalesce('=' || lang, '') AS key, sha256({_FRAMED.replace('doc_id', 'd.doc_id')}) AS h,
               CASE WHEN tampered THEN sha256({_TAMPERED.replace('doc_id', 'd.doc_id')}) ELSE sha256({_FRAMED.replace('doc_id', 'd.doc_id')}) END AS claimed
        FROM documents d LEFT JOIN marks ON marks.doc_id = d.doc_id),
    leaves AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM digests),
    {_tree_sql('low', 'leaves')},
    subroots AS (SELECT '' AS key, key AS lang, h, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n FROM low_nodes WHERE n = 1),
    {_tree_sql('top', 'subroots')},
    ways(doc_id, key, level, pos, claimed, siblings, high) AS (
        SELECT doc_id, key, 0, pos, claimed, '', false FROM leaves
        UNION ALL
        SELECT w.doc_id, CASE WHEN r.n > 1 OR w.high THEN w.key ELSE '' END, CASE WHEN r.n > 1 THEN w.level + 1 ELSE 0 END, CASE WHEN r.n > 1 THEN w.pos // 8 ELSE s.pos END,
               CASE WHEN r.n > 1 THEN sha256(r.before || w.claimed || r.after) ELSE w.claimed END, CASE WHEN r.n > 1 THEN w.siblings || r.before || r.after ELSE w.siblings END, w.high OR r.n = 1
        FROM ways w JOIN (SELECT false AS high, * FROM low_runs UNION ALL SELECT true, * FROM top_runs) r ON r.high = w.high AND r.key = w.key AND r.level = w.level AND r.pos = w.pos
        LEFT JOIN subroots s ON s.lang = w.key AND NOT w.high
        WHERE r.n > 1 OR NOT w.high),
    ends AS (
        SELECT w.doc_id, w.claimed, w.siblings FROM ways w JOIN top_nodes t ON t.key = w.key AND t.level = w.level AND t.pos = w.pos WHERE w.high AND t.n = 1)
    SELECT l.doc_id, l.h AS leaf, s.h AS subroot, t.h AS root, sha256(e.siblings) AS proof_sha256, e.claimed AS folded_root, e.claimed = t.h AS verified
    FROM leaves l JOIN ends e USING (doc_id) JOIN subroots s ON s.lang = l.key JOIN top_nodes t ON t.n = 1"""

_AUDIT_SQL = r"""
    WITH RECURSIVE texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
    split AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, doc_id > min(doc_id) OVER (PARTITION BY t) AS copy FROM texts),
    masks AS (
        SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
               + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(copy, false)::INT AS mask
        FROM split),
    marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
    cells AS (
        SELECT part, mask, count(*) AS docs, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM masks LEFT JOIN marks USING (doc_id) GROUP BY part, mask),
    letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
    prefixes(prefix, letter, bit, before, step) AS (
        SELECT '', '', 0, 0, 0
        UNION ALL
        SELECT p.prefix || l.letter, l.letter, l.bit, p.before + p.bit, p.step + 1 FROM prefixes p JOIN letters l ON NOT contains(p.prefix, l.letter)),
    orders AS (SELECT o.prefix AS filter_order, p.* FROM prefixes o JOIN prefixes p ON o.step = 5 AND p.step > 0 AND starts_with(o.prefix, p.prefix)),
    sums AS (
        SELECT part, filter_order, step, letter,
               sum(CASE WHEN mask & (before + bit) = 0 THEN docs ELSE 0 END)::BIGINT AS kept,
               sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN docs ELSE 0 END)::BIGINT AS removed,
               sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN docs ELSE 0 END)::BIGINT AS redundant,
               sum(CASE WHEN mask = bit THEN docs ELSE 0 END)::BIGINT AS unique_fails,
               sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
               sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
        FROM cells, orders GROUP BY part, filter_order, step, letter)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM sums"""

ORACLES: dict[str, str] = {
    "op11_filter_audit": _AUDIT_SQL,
    "op13_merkle_manifest": _MANIFEST_SQL,
    "op5_license_scans": _LICENSES_SQL,
    # Windows of items and of documents as strings; a word is hit when a window that begins at most nine before it occurs.
    "op1_decontamination": r"""
        WITH lowered AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        items AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        sized AS (SELECT item_id, w, least(10, len(w)) AS width FROM items WHERE len(w) > 0),
        grams AS (
            SELECT DISTINCT item_id, width, array_to_string(w[i:i + width - 1], ' ') AS g
            FROM (SELECT *, unnest(range(1, len(w) - width + 2)) AS i FROM sized)),
        widths AS (SELECT DISTINCT width FROM grams),
        places AS (
            SELECT doc_id, width, i, array_to_string(w[i:i + width - 1], ' ') AS g
            FROM (SELECT *, unnest(range(1, len(w) - width + 2)) AS i FROM lowered, widths WHERE len(w) >= width)),
        found AS (SELECT DISTINCT doc_id, width, i, item_id FROM places JOIN grams USING (width, g)),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + width)) AS p FROM found) GROUP BY doc_id),
        owners AS (
            SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
        SELECT l.doc_id, len(l.w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(o.n, 0) AS n_items,
               sha256(coalesce(o.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
        FROM lowered l LEFT JOIN hit h USING (doc_id) LEFT JOIN owners o USING (doc_id)""",
    "op8_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
               sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
}
