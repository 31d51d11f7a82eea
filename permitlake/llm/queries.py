"""The registered queries opN_<name> and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permitlake.llm import cutting, divergence, fim, langid, mixing, neardup, packing, pii, quality, rabitq, substrings, toxicity, warc
from permitlake.llm.common import held_out, table


def op1_rabitq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    _, index = warc.archive(pages)
    found = warc.lookup(index, warc.page_keys(pages))
    return warc.read_records(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(toxicity.training_rows(docs, labels))
    out = toxicity.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality.judge(docs.select("doc_id", "text"), quality.fit(docs)).drop("text")
    return out.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents")).drop("key", "mark")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = packing.pack(packing.pieces(table(spark, sf_dir, "documents")))
    return layout.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out(F.col("doc_id"))))
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.detect(docs, pii.fit(docs))
    text_of = lambda name: F.array_join(F.transform(name, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(text_of("base_spans"), 256).alias("base_sha256"), text_of("spans").alias("spans"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.in_order(mixing.mix(docs))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_cutting(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = cutting.pack(table(spark, sf_dir, "documents"))
    return layout.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_rabitq": op1_rabitq,
    "op2_warc": op2_warc,
    "op3_toxicity": op3_toxicity,
    "op4_quality": op4_quality,
    "op5_neardup": op5_neardup,
    "op6_packing": op6_packing,
    "op7_langid": op7_langid,
    "op8_substrings": op8_substrings,
    "op9_pii": op9_pii,
    "op10_mixing": op10_mixing,
    "op11_fim": op11_fim,
    "op12_cutting": op12_cutting,
    "op13_divergence": op13_divergence,
}

def _quality_sql() -> str:
    """The quality query in SQL, with the operator's production parameters."""
    p, left, rest = quality.Params(), "text", []
    for i, (_, pattern) in enumerate(quality.CLASSES):
        rest.append(f"regexp_replace({left}, '{pattern}', '', 'g') AS r{i}")
        left = f"r{i}"
    steps = "".join(f", s{i} AS (SELECT *, {r} FROM {'t' if not i else f's{i - 1}'})" for i, r in enumerate(rest))
    last = len(rest) - 1
    names = ["text", *(f"r{i}" for i in range(len(rest)))]
    sizes = ", ".join([*(f"length({a}) - length({b})" for a, b in zip(names, names[1:], strict=False)), f"length({names[-1]})"])
    at = {c: i + 1 for i, (c, _) in enumerate(quality.CLASSES)}
    k = quality.N_CLASSES
    jsd = "sqrt(greatest(0, 0.5 + sum(p * log2(2 * p / (p + q)) + q * log2(2 * q / (p + q)) - q) / 2))"
    return rf"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, text IS NOT NULL AND lang IS NOT NULL AS taught, lang FROM documents){steps},
        c AS (SELECT doc_id, text, taught, lang, [{sizes}] AS k, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, regexp_extract_all(lower(text), '\p{{L}}+') AS plain,
                list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM s{last}),
        win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM c WHERE len(ws) >= 8))),
        again AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM win WHERE n > 1) GROUP BY doc_id),
        base AS (SELECT c.*, len(ws) AS n_words, list_sum(k) - k[{at["space"]}] AS word_chars, k[{at["symbol"]}] AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words
                 FROM c LEFT JOIN again USING (doc_id)),
        judged AS (SELECT *, n_words < {p.min_words_base} OR 100 * n_repeat_words > {p.repeat_percent} * n_words AS base_failed FROM base),
        lang_k AS (SELECT lang, i, sum(k[i]) AS n FROM c, range(1, {k + 1}) r(i) WHERE taught GROUP BY lang, i),
        char_q AS (SELECT lang, i, (n + 0.5) / (sum(n) OVER (PARTITION BY lang) + 0.5 * {k}) AS q FROM lang_k),
        char_p AS (SELECT doc_id, i, k[i] / list_sum(k) AS p FROM judged, range(1, {k + 1}) r(i) WHERE NOT base_failed AND list_sum(k) >= {p.min_chars}),
        char_d AS (SELECT doc_id, min(d) AS d FROM (SELECT doc_id, lang, {jsd} AS d FROM (SELECT doc_id, lang, p, q FROM char_p JOIN char_q USING (i) WHERE p > 0) GROUP BY doc_id, lang) GROUP BY doc_id),
        counts AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(plain) AS word FROM c WHERE taught) GROUP BY ALL),
        vocabulary AS (SELECT DISTINCT word FROM (SELECT word, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r FROM counts) WHERE r <= {p.common_words}),
        totals AS (SELECT lang, sum(n) AS n FROM counts GROUP BY lang),
        known AS (SELECT lang, word, coalesce(counts.n, 0) AS n FROM totals CROSS JOIN vocabulary LEFT JOIN counts USING (lang, word)),
        every AS (SELECT lang, word, n FROM known UNION ALL SELECT totals.lang, '', any_value(totals.n) - sum(known.n) FROM totals JOIN known USING (lang) GROUP BY totals.lang),
        word_q AS (SELECT lang, word, (n + 0.5) / (sum(n) OVER (PARTITION BY lang) + 0.5 * count(*) OVER (PARTITION BY lang)) AS q FROM every),
        word_n AS (SELECT doc_id, CASE WHEN word IN (SELECT word FROM vocabulary) THEN word ELSE '' END AS word, count(*) AS n FROM
                   (SELECT doc_id, unnest(plain) AS word FROM judged WHERE NOT base_failed AND len(plain) >= {p.min_words}) GROUP BY ALL),
        word_p AS (SELECT doc_id, word, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM word_n),
        word_limit AS (SELECT {p.word_margin} * min(sqrt(greatest(0, 0.5 + (log2(2 / (1 + q)) + q * log2(2 * q / (1 + q)) - q) / 2))) AS most FROM word_q WHERE word = ''),
        word_d AS (SELECT doc_id, min(d) AS d FROM (SELECT doc_id, lang, {jsd} AS d FROM word_p JOIN word_q USING (word) GROUP BY doc_id, lang) GROUP BY doc_id)
        SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(char_d.d, 6) AS char_distance, round(word_d.d, 6) AS word_distance,
               NOT base_failed AND coalesce(char_d.d <= {p.char_limit}, true) AND coalesce(word_d.d <= (SELECT most FROM word_limit), true) AS kept
        FROM judged LEFT JOIN char_d USING (doc_id) LEFT JOIN word_d USING (doc_id)"""


SQL: dict[str, str] = {
    "op4_quality": _quality_sql(),
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
             d AS (SELECT page_id, n, sha1(html) AS digest FROM p),
             m AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS kept FROM d)
        SELECT page_id, n AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> kept THEN kept END AS refers_to
        FROM m""",
    "op8_substrings": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
             win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
             again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
             gone AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, unnest(range(i, i + 20)) AS k FROM again)),
             one AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM w),
             kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS t FROM one ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id),
             n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT doc_id, len(ws) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op11_fim": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
             u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS h FROM t),
             c AS (SELECT doc_id, text, units, len(units) AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b,
                     CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
             p AS (SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
        FROM p""",
    "op13_divergence": r"""
        WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
             held AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(ts)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 10),
             n AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(ts) AS term FROM d) SEMI JOIN held USING (lang, term) GROUP BY ALL),
             groups AS (SELECT DISTINCT lang, source FROM d),
             v AS (SELECT lang, count(*) AS v FROM held GROUP BY lang),
             c AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM groups JOIN held USING (lang) LEFT JOIN n USING (lang, source, term)),
             p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v)::HUGEINT AS p FROM c JOIN v USING (lang)),
             l AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v)::HUGEINT AS q FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM n GROUP BY ALL) JOIN v USING (lang)),
             two AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
             pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN two ON two.lang = a.lang AND two.source = a.source AND two.item = b.source),
             term AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
        WHERE part = 'pair' OR rank <= 10""",
}
