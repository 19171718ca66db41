"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pulsegrid.llm.bpe import tokenize

    out = tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op6_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.bytecnn import predict, train
    from pulsegrid.llm.common import held_out

    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op10_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.common import held_out
    from pulsegrid.llm.mil import score, train

    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op8_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.gracededup import decisions

    return decisions(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLES["op8_grace_dedup"] = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
     d AS (SELECT doc_id, points, sha256(norm) AS text_sha256 FROM n),
     w AS (SELECT doc_id, text_sha256, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                  row_number() OVER g = 1 AS kept
           FROM d WINDOW g AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id))
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM w
"""


@query
def op9_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.mixing import mixed

    return mixed(table(spark, sf_dir, "documents"))


@query
def op5_icws_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.icws import NearDuplicates

    return NearDuplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).classes()


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.warc import read_archives, write_archives

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return read_archives(write_archives(pages), payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op4_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.crf import judge, train

    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))


@query
def op2_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.preferences import format_preferences, neighbours

    out = format_preferences(neighbours(table(spark, sf_dir, "conversations")))
    runs = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["length"], x["learned"].cast("int"))), ",")
    return out.withColumn("chosen_mask", runs("chosen_mask")).withColumn("rejected_mask", runs("rejected_mask"))


ORACLES["op2_preferences"] = r"""
WITH t AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
           FROM conversations WHERE conv_id IS NOT NULL),
     c AS (SELECT * FROM t WHERE side = 0), r AS (SELECT * FROM t WHERE side = 1),
     m AS (SELECT pair_id, i, c.role IS NOT NULL AND r.role IS NOT NULL AND c.role = r.role AND c.text = r.text AS same
           FROM c FULL JOIN r USING (pair_id, i)),
     p AS (SELECT pair_id, coalesce(min(i) FILTER (WHERE same IS NOT TRUE) - 1, max(i)) AS n FROM m GROUP BY pair_id),
     x AS (SELECT t.*, p.n, '<|start|>' || role || chr(10) AS head, text || '<|end|>' || chr(10) AS body FROM t JOIN p USING (pair_id)),
     y AS (SELECT *, length(head) || ':0,' || length(body) || CASE WHEN role = 'assistant' THEN ':1' ELSE ':0' END AS mask FROM x)
SELECT pair_id, min(conv_id) FILTER (WHERE side = 0) AS chosen_id, min(conv_id) FILTER (WHERE side = 1) AS rejected_id, min(n) AS n_prompt_turns,
       coalesce(string_agg(head || body, '' ORDER BY i) FILTER (WHERE side = 0 AND i <= n), '') AS prompt,
       coalesce(string_agg(head || body, '' ORDER BY i) FILTER (WHERE side = 0 AND i > n), '') AS chosen,
       coalesce(string_agg(mask, ',' ORDER BY i) FILTER (WHERE side = 0 AND i > n), '') AS chosen_mask,
       coalesce(string_agg(head || body, '' ORDER BY i) FILTER (WHERE side = 1 AND i > n), '') AS rejected,
       coalesce(string_agg(mask, ',' ORDER BY i) FILTER (WHERE side = 1 AND i > n), '') AS rejected_mask
FROM y GROUP BY pair_id HAVING count(*) FILTER (WHERE side = 0) > 0 AND count(*) FILTER (WHERE side = 1) > 0
"""


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.licences import scan

    return scan(table(spark, sf_dir, "documents"))


ORACLES["op1_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
     d AS (SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha1(payload) AS hex, unhex(sha1(payload))::BIT::VARCHAR AS bits, max(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, payload_bytes, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: substr(bits, 5 * i + j + 1, 1)::INT * (16 >> j)))::INT, 1)), '') AS payload_digest
FROM d
"""


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.infill import fill_in_middle

    return fill_in_middle(table(spark, sf_dir, "documents"), output=False)


ORACLES["op13_fill_in_middle"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS hex FROM documents),
     u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units, list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(hex, k, 8))::UBIGINT::BIGINT) AS h FROM t),
     d AS (SELECT *, len(units) AS n, text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 AS plain FROM u),
     c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS lo, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS hi FROM d),
     p AS (SELECT *, array_to_string(units[1:lo], '') AS prefix, array_to_string(units[lo + 1:hi], '') AS middle, array_to_string(units[hi + 1:], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, CASE WHEN plain THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN length(prefix) END AS prefix_chars, CASE WHEN NOT plain THEN length(middle) END AS middle_chars,
       sha256(CASE WHEN plain THEN text WHEN h[4] % 100 < 50 THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.merkle import Manifest

    docs = table(spark, sf_dir, "documents")
    more = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0).cast("int")
    return Manifest(docs, tampered={"n_chars": F.col("n_chars") + F.coalesce(more, F.lit(0))}).verified()


def _trees(name: str, leaves: str) -> str:
    """CTEs of all nodes of the trees of `leaves` (g, i, h), and of each tree's highest level."""
    return f"""
     {name}(g, l, i, h) AS (SELECT g, 0, i, h FROM {leaves} UNION ALL
        SELECT g, any_value(l) + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {name}) WHERE n > 1 GROUP BY g, i // 2),
     {name}_top AS (SELECT g, max(l) AS l FROM {name} GROUP BY g)"""


_FIELD = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR, '-')"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n_chars}", "text"))

ORACLES["op11_merkle_manifest"] = f"""
WITH RECURSIVE
     crc_bits(c, v, k) AS (SELECT r, r::UBIGINT, 0 FROM range(256) t(r) UNION ALL
        SELECT c, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END, k + 1 FROM crc_bits WHERE k < 8),
     crc_table AS (SELECT list(v ORDER BY c) AS t FROM crc_bits WHERE k = 8),
     crc(doc_id, s, v) AS (SELECT DISTINCT doc_id, doc_id::VARCHAR, 4294967295::UBIGINT FROM documents WHERE doc_id IS NOT NULL UNION ALL
        SELECT doc_id, substr(s, 2), xor(v >> 8, t[(xor(v, ascii(s)::UBIGINT) & 255)::BIGINT + 1]) FROM crc, crc_table WHERE s <> ''),
     hit AS (SELECT doc_id FROM crc WHERE s = '' AND xor(v, 4294967295::UBIGINT) % 7 = 0),
     signed AS (SELECT doc_id, lang, sha256({_LEAF.replace("{n_chars}", "n_chars")}) AS leaf, sha256({_LEAF.replace("{n_chars}", "(n_chars + (doc_id IN (FROM hit))::INT)")}) AS now FROM documents),
     docs AS (SELECT *, coalesce('=' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, now) - 1 AS i FROM signed),
     leaves AS (SELECT g, i, leaf AS h FROM docs),{_trees("low", "leaves")},
     subroots AS (SELECT g AS name, 0 AS g, row_number() OVER (ORDER BY g) - 1 AS i, h FROM low SEMI JOIN low_top USING (g, l)),{_trees("high", "subroots")},
     root AS (SELECT h AS root FROM high SEMI JOIN high_top USING (g, l)),
     steps AS (
        SELECT d.g, d.i, l.l, d.i >> l.l AS own, s.h FROM docs d JOIN (SELECT DISTINCT g, l FROM low) l USING (g) JOIN low_top t USING (g) LEFT JOIN low s ON s.g = d.g AND s.l = l.l AND s.i = xor(d.i >> l.l, 1) WHERE l.l < t.l
        UNION ALL
        SELECT d.g, d.i, 1000 + l.l, r.i >> l.l, s.h FROM docs d JOIN subroots r ON r.name = d.g JOIN (SELECT DISTINCT l FROM high) l ON l.l < (SELECT max(l) FROM high) LEFT JOIN high s ON s.l = l.l AND s.i = xor(r.i >> l.l, 1)),
     paths AS (SELECT g, i, list(struct_pack(odd := own % 2 = 1, h := h) ORDER BY l) AS path, string_agg(h, '' ORDER BY l) AS siblings FROM steps GROUP BY g, i),
     folds(g, i, k, h, path) AS (SELECT d.g, d.i, 1, d.now, coalesce(p.path, []) FROM docs d LEFT JOIN paths p USING (g, i) UNION ALL
        SELECT g, i, k + 1, sha256(CASE WHEN path[k].h IS NULL THEN h WHEN path[k].odd THEN path[k].h || h ELSE h || path[k].h END), path FROM folds WHERE k <= len(path))
SELECT d.doc_id, d.leaf, r.h AS subroot, root.root, sha256(coalesce(p.siblings, '')) AS proof_sha256, f.h AS folded_root, f.h = root.root AS verified
FROM docs d JOIN root ON true JOIN subroots r ON r.name = d.g LEFT JOIN paths p ON p.g = d.g AND p.i = d.i JOIN folds f ON f.g = d.g AND f.i = d.i AND f.k = len(f.path) + 1
"""


@query
def op12_rp_forest_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.rpforest import NearVectors

    return NearVectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).components()
