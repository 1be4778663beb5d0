"""The registered ``opN_*`` queries: each applies its operator to its whole table and derives the
digest columns.  ``QUERIES`` maps names to ``(spark, sf_dir) -> DataFrame``; ``ORACLE`` has DuckDB
SQL where SQL can state the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm import (bpe, collocations, decontaminate, hmm, jaccard_join, language_id, prefix_trie, repeats, simple8b,
                         syncmers, toxicity, url_rules, warc)
from ferrule.session import scratch_path
from ferrule.sources.tables import read_table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HMM and unigram log10 probabilities of all documents."""
    held_out = language_id.remainder("doc_id", 7) == 2
    out = hmm.score_texts(documents(spark, sf_dir), ~held_out, carry=F.struct("doc_id", held_out.alias("held_out")))
    return out.select("row.doc_id", "row.held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words under windows of 13 that also start in a smaller document, removed."""
    out = repeats.remove_repeats(documents(spark, sf_dir), window=13, carry=F.struct("doc_id"))
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple-8b files of the byte-level BPE ids of all documents, read back."""
    target = scratch_path(spark, "token-ids")
    simple8b.write_ids(documents(spark, sf_dir), target, public_tokenizers.path("byte_bpe_50k.json"))
    return simple8b.read_ids(spark, target).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment-tree BPE over all documents and back."""
    docs = documents(spark, sf_dir)
    out = bpe.bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), carry=F.struct("doc_id"))
    return out.select("row.doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside the held-out fold."""
    held_out = language_id.remainder("doc_id", 5) == 0
    out = toxicity.score_toxicity(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"), ~held_out,
                                  carry=F.struct("doc_id", held_out.alias("held_out")))
    return out.select("row.doc_id", "row.held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the documents under shingle Jaccard links of 0.75."""
    return jaccard_join.jaccard_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syncmer fingerprints of all documents, compared with their edited texts and the next document."""
    out = syncmers.compare_with_next(documents(spark, sf_dir), carry=F.struct("doc_id"))
    return out.select("row.doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
                      "edited_fingerprint", "near_edited", "near_next")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the default rules on the url of every page."""
    pages = read_table(spark, sf_dir, "pages", ["page_id", "url"])
    return url_rules.judge(pages, url_rules.default_rules(), carry=F.struct("page_id")).select(
        "row.page_id", "host", "path", "rule", "verdict")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those outside the held-out fold."""
    docs, vocabulary = documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    held_out = language_id.remainder("doc_id", 5) == 0
    model = language_id.train(docs.where(~held_out).select("doc_id", "text", "lang"), vocabulary)
    out = language_id.identify(docs, model, vocabulary, carry=F.struct("doc_id", held_out.alias("held_out")))
    return out.select("row.doc_id", "row.held_out", "lang_pred", "score")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaking (document, benchmark item) pairs."""
    return decontaminate.leaks(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as whole-file gzip archives, normalised and read back by their index."""
    pages = read_table(spark, sf_dir, "pages", ["page_id", "url", "html"])
    streams = warc.write_archives(pages, scratch_path(spark, "warc-streams"))
    out = warc.read_archives(warc.normalise(streams, scratch_path(spark, "warc")))
    return out.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations with their subtree totals."""
    turns, conv_ids = prefix_trie.rebuilt(prefix_trie.turns(read_table(spark, sf_dir, "conversations")))
    return prefix_trie.trie_report(prefix_trie.prefix_trie(turns, conv_ids)).drop("key")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2,000 collocations of every language."""
    return collocations.collocations(documents(spark, sf_dir)).drop("k")


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_token_ids": op3_token_ids,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_toxicity": op5_toxicity,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_fingerprints": op7_fingerprints,
    "op8_url_filter": op8_url_filter,
    "op9_language_id": op9_language_id,
    "op10_decontamination": op10_decontamination,
    "op11_warc": op11_warc,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_collocations": op13_collocations,
}

OP8_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(rest, '^[^?#]*((.|\n)*)$', 1) AS more
  FROM parts
), rules(rhost, rpath, rverdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), best AS (
  SELECT split.*, (SELECT arg_max(struct_pack(name := rhost || rpath, verdict := rverdict), length(rhost || rpath)) FROM rules
                   WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS r
  FROM split
)
SELECT page_id, host, path, r.name AS rule,
       coalesce(r.verdict, CASE WHEN contains(host || path || more, '/ads/') OR contains(host || path || more, '/popup/')
                                  OR regexp_matches(host || path || more, '[?].*sessionid=') THEN 'block' ELSE 'allow' END) AS verdict
FROM best
"""

OP11_SQL = r"""
WITH rows AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS size FROM pages
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS first, sha1(encode(html)) AS hex FROM rows
), digits AS (
  SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    (('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '') AS digest
  FROM firsts
)
SELECT page_id, size AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM digits
"""

OP12_SQL = r"""
WITH bits AS (
  SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS c FROM range(256) AS bytes(b))
), said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS said
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, said) AS w FROM said GROUP BY conv_id
), plan AS (
  SELECT conv_id, w, conv_id - conv_id % 100 AS base, xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
    lambda c, d: xor(t[1 + (xor(c, d) & 255)], c >> 8))) % 6 AS h
  FROM own, bits
), convs AS (
  SELECT plan.conv_id, list_concat(coalesce(b.w[1:h], []), plan.w[h + 1:]) AS w FROM plan LEFT JOIN own AS b ON b.conv_id = base
), members AS (
  SELECT conv_id, w[1:depth] AS path, depth, len(w) = depth AS ends FROM (SELECT *, unnest(range(0, len(w) + 1)) AS depth FROM convs)
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY path, depth
), children AS (
  SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), own_values AS (
  SELECT nodes.*, coalesce(c.n, 0) AS n_children,
         CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(nodes.path[depth].text) END AS saved
  FROM nodes LEFT JOIN children AS c ON c.path = nodes.path
), subtrees AS (
  SELECT path[1:d] AS path, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM own_values) GROUP BY 1
)
SELECT o.conv_id, o.depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, s.n_leaves, s.saved_tokens, o.ends_sha256
FROM own_values AS o JOIN subtrees AS s ON s.path = o.path LEFT JOIN nodes AS p ON o.depth > 0 AND p.path = o.path[1:o.depth - 1]
"""

OP13_SQL = r"""
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents
), pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(low, '[.,;:!?\n\x0B\f\r]')) AS piece FROM docs)
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang
), phrases AS (
  SELECT lang, size, phrase, count(*)::BIGINT AS f
  FROM (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
        FROM pieces, range(1, 5) AS sizes(size) WHERE len(w) >= size)
  GROUP BY ALL HAVING count(*) >= 30
), candidates AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM phrases WHERE size > 1
), cuts AS (
  SELECT c.lang, c.phrase, c.a, c.size, k, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f + y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) AS c
  JOIN phrases AS x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
  JOIN phrases AS y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:c.size], ' ')
), weakest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), around AS (
  SELECT lang, array_to_string(w[b:b + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, size - m + 2)) AS b FROM (SELECT *, unnest(range(2, size)) AS m FROM candidates))
  GROUP BY ALL
), ranked AS (
  SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, encode(w.phrase)) AS rank
  FROM weakest AS w LEFT JOIN around AS o ON o.lang = w.lang AND o.phrase = w.phrase
  WHERE o.longer IS NULL OR 100::HUGEINT * o.longer < 80::HUGEINT * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

ORACLE: dict[str, str] = {"op8_url_filter": OP8_SQL, "op11_warc": OP11_SQL, "op12_prefix_trie": OP12_SQL,
                          "op13_collocations": OP13_SQL}
