"""Registered queries of this folder: each operator over its whole table, with DuckDB SQL where SQL can say it."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import exact, jaccard, language, lines, neighbours, packing, pieces, quality, repair, secrets, sharding, spelling, suffix

QUERIES, ORACLES = {}, {}
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
LINE_BATCHES = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@query("op1_sentencepiece")
def op1_sentencepiece(spark, folder):
    """Piece ids of every document, and whether decoding them gives the text back."""
    vocabulary = pieces.load(MODEL)
    coded = pieces.decode(pieces.encode(_documents(spark, folder).select("doc_id", "text"), vocabulary), vocabulary)
    return coded.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"),
                        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


@query("op2_jaccard_join", f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS a FROM documents),
s AS (SELECT doc_id, CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 3 THEN [array_to_string(a, ' ')]
      ELSE list_distinct([a[i] || ' ' || a[i + 1] || ' ' || a[i + 2] FOR i IN range(1, len(a) - 1)]) END AS g FROM w),
n AS (SELECT doc_id, len(g) AS n FROM s),
e AS (SELECT doc_id, unnest(g) AS g FROM s),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 90 * (p.n + q.n - common)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT r.a AS doc_id, any_value(n.n) AS n_shingles, min(r.b) AS component_id, (SELECT count(*) FROM l WHERE l.a = r.a) AS n_links
FROM r JOIN n ON n.doc_id = r.a GROUP BY r.a""")
def op2_jaccard_join(spark, folder):
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    return jaccard.jaccard_components(_documents(spark, folder), jaccard.Threshold(3, 90))


@query("op3_exact_dedup", """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""")
def op3_exact_dedup(spark, folder):
    """Every document with the one that stays for its text, through a new digest index."""
    return exact.deduplicate(_documents(spark, folder), exact.create_index(spark)).drop("batch_row")


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark, folder):
    """Every document without the bytes of 100-byte strings that also start earlier."""
    out = suffix.remove_repeats(_documents(spark, folder))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_line_dedup", f"""
WITH parts AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k FROM parts),
held AS (SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
judged AS (SELECT doc_id, i, line, first_doc IS NOT NULL AND first_doc <> doc_id AS lost FROM keyed LEFT JOIN held USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id""")
def op5_line_dedup(spark, folder):
    """Every document without the lines that an earlier document holds, through a new line index.

    The documents come in batches by a hash of their id, so that the filters are asked for all but the first.
    """
    docs = _documents(spark, folder)
    index = lines.LineIndex(spark)
    for k in range(LINE_BATCHES):
        index.insert(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(LINE_BATCHES)) == k))
    return index.apply(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op6_language_id")
def op6_language_id(spark, folder):
    """The language of every document, learned from two thirds of them."""
    docs = _documents(spark, folder)
    profiles = language.learn(docs.filter(~language.held_out(F.col("doc_id"))))
    found = language.identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op7_nearest_neighbours")
def op7_nearest_neighbours(spark, folder):
    """The 20 nearest vectors of every twentieth vector."""
    return neighbours.nearest(spark.read.parquet(f"{folder}/embeddings.parquet"), "vec_id", "embedding", 20, 20)


@query("op8_hilbert_shards")
def op8_hilbert_shards(spark, folder):
    """All documents in eight shards along a Hilbert curve through language, source, length and id."""
    text = F.encode(F.col("text"), "utf-8")
    docs = _documents(spark, folder).select(
        "doc_id", "lang", "source", "n_chars", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"))
    out = sharding.shard(docs, 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark, folder):
    """All documents, by words, packed into bins of 512 to 4096."""
    docs = _documents(spark, folder)
    return packing.pack(docs, packing.word_count(F.col("text")))


def _found(kind, pattern, number, length):
    """Matches of one kind by place: pieces between matches and matches alternate."""
    return f"""
  SELECT doc_id, '{kind}' AS kind, {number} AS k, i, length(h) AS size, {length} AS value,
         sum(length(g) + length(h)) OVER (PARTITION BY doc_id ORDER BY i) AS stop
  FROM (SELECT doc_id, unnest(regexp_extract_all(t, '{pattern}')) AS h, unnest(string_split_regex(t, '{pattern}')[:-2]) AS g,
               generate_subscripts(regexp_extract_all(t, '{pattern}'), 1) AS i FROM texts)"""


_ASSIGN = secrets.RULES[0][1].replace("'", "''")


@query("op10_secret_scan", f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_found("assign", _ASSIGN, 0, f"length(regexp_extract(h, '{_ASSIGN}', 2))")}
  UNION ALL {_found("access", "AKIA[A-Z0-9]+", 1, "length(h) - 6")}
  UNION ALL {_found("hex", "[0-9a-f]+", 2, "length(h) - 4")}),
spans AS (SELECT doc_id, kind, k, stop - size AS start, kind || ':' || (stop - size) || ':' || stop AS span FROM found WHERE value >= 12)
SELECT d.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
       count(*) FILTER (WHERE kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, k), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, k), '') AS spans
FROM documents d LEFT JOIN spans s ON d.doc_id = s.doc_id GROUP BY d.doc_id""")
def op10_secret_scan(spark, folder):
    """Secrets of every document, through a new ledger of scanned blobs."""
    found = secrets.scan(_documents(spark, folder), "doc_id", secrets.new_ledger(spark))
    return secrets.report(found).withColumnRenamed("path", "doc_id")


@query("op11_conversation_repair")
def op11_conversation_repair(spark, folder):
    """Every damaged conversation with its faults, and the cheapest repair that is least in its audit."""
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair.digest(repair.repair(repair.damage(rows)), rows)


@query("op12_spelling_variants")
def op12_spelling_variants(spark, folder):
    """The vocabulary of all documents with each word's near words, form and root."""
    return spelling.group_variants(spelling.vocabulary(_documents(spark, folder)))


_UNITS = ", ".join(f"('{name}', {width}, {str(sides).lower()})" for name, (width, sides) in quality.MEASURES.items())


def _quartile(quarters):
    index = f"min(bucket) FILTER (WHERE 4 * upto >= {quarters} * rows)"
    shift = f"greatest({index} // 16 - 1, 0)"
    return f"((({index} - 16 * {shift} + 1)::BIGINT << {shift}::BIGINT) - 1)"


@query("op13_quality_rules", f"""
WITH units(measure, width, low_too) AS (VALUES {_UNITS}),
texts AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
          list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS g
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM texts)),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM again) GROUP BY doc_id),
counts AS (SELECT doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
           len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines FROM texts LEFT JOIN covered USING (doc_id)),
base AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts),
each AS (SELECT doc_id, lang, source, unnest([{{'measure': 'word_length', 'v': 1000 * word_chars // n_words}}, {{'measure': 'symbols', 'v': 1000 * n_symbols // n_words}},
         {{'measure': 'dup_lines', 'v': 1000 * n_dup_lines // n_lines}}], recursive := true)
         FROM base WHERE NOT base_failed),
bucketed AS (SELECT *, greatest(length(bin(v)) - 5, 0) AS sh FROM each),
sums AS (SELECT grouping(lang, source) AS level, lang, source, measure, sh * 16 + (v >> sh) AS bucket, count(*) AS n FROM bucketed
         GROUP BY GROUPING SETS ((lang, source, measure, sh * 16 + (v >> sh)), (lang, measure, sh * 16 + (v >> sh)), (measure, sh * 16 + (v >> sh)))),
runs AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, measure) AS rows FROM sums),
quartiles AS (SELECT level, lang, source, measure, rows, {_quartile(1)} AS q1, {_quartile(3)} AS q3 FROM runs GROUP BY level, lang, source, measure, rows),
fences AS (SELECT level, lang, source, measure, low_too, q1 - {quality.REACH} * greatest(q3 - q1, width) AS low, q3 + {quality.REACH} * greatest(q3 - q1, width) AS high
           FROM quartiles JOIN units USING (measure) WHERE rows >= {quality.LEAST_ROWS}),
outside AS (SELECT doc_id, v > coalesce(a.high, b.high, c.high) OR (coalesce(a.low_too, b.low_too, c.low_too) AND v < coalesce(a.low, b.low, c.low)) AS fails
  FROM each e LEFT JOIN fences a ON a.level = 0 AND a.measure = e.measure AND a.lang IS NOT DISTINCT FROM e.lang AND a.source IS NOT DISTINCT FROM e.source
  LEFT JOIN fences b ON b.level = 1 AND b.measure = e.measure AND b.lang IS NOT DISTINCT FROM e.lang LEFT JOIN fences c ON c.level = 3 AND c.measure = e.measure),
failed AS (SELECT doc_id, count(*) AS n FROM outside WHERE fails GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n IS NULL AS kept
FROM base LEFT JOIN failed USING (doc_id)""")
def op13_quality_rules(spark, folder):
    """Counts of every document and whether it stays under thresholds learned per language and source."""
    out = quality.filter_documents(_documents(spark, folder))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
