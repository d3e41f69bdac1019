"""The operators' registered queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, decontaminate, digests, html, langid, mix, neighbours, ranking, setjoin, substrings, toxicity, warc
from .common import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_warc(warc.write_warc(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.extract_text(pages, html.fit_extractor(pages)).select("page_id", "url", "text", "n_chars")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", langid.held_out(modulus=5, rest=0))
    labels = table(spark, sf_dir, "labels").where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~langid.held_out(modulus=5, rest=0))
    # the training rows are drawn before the texts are joined: see fit_docs
    draw = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    drawn = labels.where(draw <= min(1.0, 20_000 / max(1, labels.count())))
    model = toxicity.fit_toxicity(docs.where(~F.col("held_out")).join(drawn, "doc_id"))
    return toxicity.score_toxicity(docs, model).select("doc_id", "held_out", "score", "predicted", "toxic_sentences")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string"))
    back = chat.read_chats(chat.format_chats(turns))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs, keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.jaccard_components(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out())
    model = langid.fit_languages(docs.where(~F.col("held_out")))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(ranking.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align_tokens(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    return alignment.score_links(aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.exact_groups(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/digests-{uuid.uuid4().hex}")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_warc, op2_decontamination, op3_html_extraction, op4_mixing, op5_embedding_dedup, op6_toxicity, op7_chat_formatting, op8_substring_dedup, op9_ngram_jaccard, op10_language_id, op11_ranked_search, op12_tokenizer_alignment, op13_exact_dedup)
}

_BITS = " + ".join(f"{16 >> b} * CAST(substr(bits, CAST(5 * i + {b + 1} AS INT), 1) = '1' AS INT)" for b in range(5))
_ESCAPED = "length({0}) + length({0}) - length(replace(replace(replace({0}, '\\', ''), '<', ''), '[', ''))"

_ROLE = _ESCAPED.format("r") + " + length(r) - length(replace(r, ']', ''))"

ORACLES: dict[str, str] = {
    "op1_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
        f AS (SELECT s, min(page_id) AS first FROM p GROUP BY s),
        b AS (SELECT page_id, strlen(h) AS n, CAST(CAST(unhex(s) AS BIT) AS VARCHAR) AS bits, first FROM p JOIN f USING (s))
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
            array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_BITS}, 1)), '') AS payload_digest,
            CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id > first THEN first END AS refers_to
        FROM b""",
    "op5_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
        r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a, min(b) AS c FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(v.vec_id, coalesce(c.c, v.vec_id)) AS component_id,
            v.vec_id = least(v.vec_id, coalesce(c.c, v.vec_id)) AS kept
        FROM v LEFT JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id""",
    "op7_chat_formatting": f"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
        o AS (SELECT *, lag(r) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, x) AS before,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, x) AS k FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY k)) AS turns_sha256,
            CAST(coalesce(sum(length(x)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(x, '' ORDER BY k) FILTER (r = 'assistant'), '')) AS loss_sha256,
            CAST(8 + 6 + sum(({_ESCAPED.format('x')}) + CASE WHEN k = 1 THEN 8 + ({_ROLE}) WHEN r = before THEN 6 ELSE 14 + ({_ROLE}) END) AS BIGINT) AS formatted_chars
        FROM o GROUP BY conv_id""",
    "op8_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        g AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) > 12)),
        m AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h),
        c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN m USING (h) WHERE doc_id > first),
        x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
        k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM x ANTI JOIN c USING (doc_id, p) GROUP BY doc_id),
        n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op9_ngram_jaccard": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        l AS (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
            JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
        r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
        SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(c.c, w.doc_id)) AS component_id
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = w.doc_id""",
    "op11_ranked_search": r"""
        WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents WHERE text IS NOT NULL),
        q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY 1, 2),
        n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id), a AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM w SEMI JOIN q USING (term) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        i AS (SELECT tf.doc_id, tf.term, CAST(floor(1000 * ln((2 * a.docs + 2) / (2 * df.df + 1))) AS BIGINT) * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + (75 * n.n * a.docs) // a.terms))) AS v FROM tf JOIN df USING (term) JOIN n USING (doc_id), a),
        s AS (SELECT item_id, doc_id, CAST(sum(times * v) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY 1, 2)
        SELECT * FROM (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0) WHERE rank <= 10""",
    "op13_exact_dedup": """
        WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS s FROM documents),
        g AS (SELECT s, max(doc_id) AS keep_id, count(*) AS n FROM t GROUP BY s)
        SELECT doc_id, keep_id, n AS group_size, doc_id = keep_id AS kept, s AS text_sha256 FROM t JOIN g USING (s)""",
}
