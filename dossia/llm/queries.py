"""The queries of this subpackage over the shared tables, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossia.llm.common import read, shared_dir

def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dossia.llm.bpe import bpe_decode, bpe_encode

    path = vocabulary("word_bpe_49k.json")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe_decode(bpe_encode(docs, path, keep_text=False), path)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dossia.llm import langid

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    test = langid.held_out(F.col("doc_id"), 5, 0)
    model = langid.fit(docs.where(~test), vocabulary("piece_bpe_32k.model"))
    return langid.predict(docs.select("doc_id", test.alias("held_out"), "text"), model, keep_text=False)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dossia.llm import toxicity
    from dossia.llm.langid import held_out

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    test = held_out(F.col("doc_id"), 4, 2)
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").where(~test)
    model = toxicity.fit(toxicity.labelled_texts(docs, labels), label_col="label", id_col="_id")
    scored = toxicity.score_texts(docs.select("doc_id", test.alias("held_out"), "text"), model, keep_text=False)
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dossia.llm.exact_dedup import exact_dedup

    return exact_dedup(read(spark, sf_dir, "documents"), digest="all").withColumnRenamed("digest", "text_sha256")


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op5_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dossia.llm.url_graph import Rule, judge_urls

    judged = judge_urls(read(spark, sf_dir, "pages"), [Rule(*r) for r in RULES])
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dossia.llm.jaccard_join import jaccard_components

    return jaccard_components(read(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dossia.llm.topk import top_k

    vectors = read(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dossia.llm.packing import pack_documents

    return pack_documents(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), keep_ids=False)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dossia.llm.substring import substring_dedup

    done = substring_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the shards of whole documents; the digests are taken from what was written."""
    from dossia.llm.sharding import read_shards, record_size, write_shards

    docs = read(spark, sf_dir, "documents")
    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    write_shards(docs, path, shards=40)
    written = read_shards(spark, path, docs.schema)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return written.select(
        "doc_id", record_size(F.col("text")).alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dossia.llm.token_alignment import aligned_scores

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    done = aligned_scores(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    return done.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dossia.llm.filter_audit import filter_audit

    return filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dossia.llm.embedding_dedup import vector_groups

    return vector_groups(read(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe, op2_language_id, op3_toxicity, op4_exact_dedup, op5_link_graph, op6_jaccard, op7_topk, op8_packing, op9_substring_dedup, op10_sharding,
        op11_token_alignment, op12_filter_audit, op13_embedding_dedup,
    )
}

def _link_graph_sql() -> str:
    """The same judgement as one statement: rules, edges between hosts, and each round of both walks as a table of its own."""
    from dossia.llm import url_graph as g

    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rest = "CASE WHEN strpos({0}, '://') > 0 THEN substr({0}, strpos({0}, '://') + 3) ELSE '' END"
    host = lambda c: lower.format(f"regexp_extract(coalesce({rest.format(c)}, ''), '^([^/?#]*)', 1)")
    path = f"regexp_extract(coalesce({rest.format('url')}, ''), '^[^/?#]*([^?#]*)', 1)"
    fits = lambda r: f"(host = '{r[1]}' OR suffix(host, '.{r[1]}')) AND prefix(path, '{r[2]}')"
    longest_first = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{value(r)}'" for r in longest_first) + " END"
    rounds = []
    for k in range(g.ROUNDS):
        rounds.append(f"""r{k + 1} AS (SELECT kind, host, sum(score) AS score FROM (
            SELECT w.kind, w.dst AS host, r{k}.score * w.w * {g.DAMPING} AS score FROM r{k} JOIN w ON r{k}.kind = w.kind AND r{k}.host = w.src
            UNION ALL SELECT kind, host, score * {1 - g.DAMPING} FROM r0) GROUP BY kind, host)""")
    return f"""
        WITH p AS (SELECT page_id, html, {host("url")} AS host, {path} AS path FROM pages),
        j AS (SELECT page_id, host, path, {case(lambda r: r[1] + r[2])} AS rule, {case(lambda r: r[0])} AS by_rule FROM p),
        h AS (SELECT host AS src, unnest(regexp_extract_all(html, '{g.HREF.replace("'", "''")}', 1)) AS quoted FROM p),
        l AS (SELECT src, CASE WHEN prefix(href, '//') THEN 'http:' || href ELSE href END AS href FROM (SELECT src, trim(quoted, chr(34) || chr(39)) AS href FROM h) WHERE contains(href, '//')),
        e AS (SELECT src, dst, count(*) AS n FROM (SELECT src, {host("href")} AS dst FROM l) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
        b AS (SELECT 'allow' AS kind, src, dst, n FROM e UNION ALL SELECT 'block', dst, src, n FROM e UNION ALL SELECT 'page', dst, src, n FROM e),
        w AS (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS w FROM b),
        c AS (SELECT by_rule AS kind, host, count(*) AS n FROM j WHERE by_rule IS NOT NULL AND host <> '' GROUP BY by_rule, host
              UNION ALL SELECT 'page', host, count(*) FROM j WHERE host <> '' GROUP BY host),
        r0 AS (SELECT kind, host, n / sum(n) OVER (PARTITION BY kind) AS score FROM c),
        {", ".join(rounds)},
        s AS (SELECT host, coalesce(sum(CASE WHEN kind = 'allow' THEN score END), 0) AS trust, coalesce(sum(CASE WHEN kind = 'block' THEN score END), 0) AS distrust,
                     coalesce(sum(CASE WHEN kind = 'page' THEN score END), 0) AS usual FROM r{g.ROUNDS} GROUP BY host)
        SELECT j.page_id, j.host, j.path, j.rule,
               coalesce(j.by_rule, CASE WHEN s.distrust > {g.THRESHOLD * (1 + g.TOLERANCE)} * greatest(s.trust, s.usual) THEN 'block' ELSE 'allow' END) AS verdict
        FROM j LEFT JOIN s ON j.host = s.host AND j.host <> ''"""


ORACLES = {
    "op5_link_graph": _link_graph_sql(),
    "op4_exact_dedup": """
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents
        ), g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
        FROM d JOIN g USING (text_sha256)""",
    "op7_topk": """
        WITH v AS (
            SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
            FROM embeddings
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op6_jaccard": r"""
        WITH RECURSIVE t AS (
            SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w
            FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS shingles
            FROM t
        ), e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS g FROM s),
        l AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
        ), r AS (SELECT a AS doc_id, b AS reached FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reached = l.a),
        c AS (SELECT doc_id, min(reached) AS least FROM r GROUP BY doc_id)
        SELECT doc_id, len(shingles) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id FROM s LEFT JOIN c USING (doc_id)""",
    "op9_substring_dedup": r"""
        WITH t AS (
            SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents
        ), g AS (SELECT doc_id, unnest([{'start': i, 'words': array_to_string(w[i:i + 19], ' ')} FOR i IN range(1, len(w) - 18)]) AS g FROM t),
        f AS (SELECT g.words AS words, min({'doc_id': doc_id, 'start': g.start}) AS first FROM g GROUP BY g.words),
        gone AS (
            SELECT DISTINCT doc_id, unnest(range(g.start, g.start + 20)) AS place FROM g JOIN f ON g.words = f.words
            WHERE {'doc_id': doc_id, 'start': g.start} > f.first
        ), each AS (SELECT doc_id, unnest([{'place': i, 'word': w[i]} FOR i IN range(1, len(w) + 1)]) AS e FROM t),
        kept AS (
            SELECT each.doc_id, string_agg(e.word, ' ' ORDER BY e.place) AS text, count(*) AS n FROM each ANTI JOIN gone ON each.doc_id = gone.doc_id AND e.place = gone.place GROUP BY each.doc_id
        )
        SELECT t.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM t LEFT JOIN kept ON t.doc_id = kept.doc_id""",
    "op12_filter_audit": r"""
        WITH RECURSIVE t AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
        ), g AS (SELECT text, min(doc_id) AS least FROM t GROUP BY text),
        w AS (
            SELECT t.*, doc_id > least AS copy, [x FOR x IN regexp_split_to_array(text, '[\x20\x09-\x0D]+') IF x <> ''] AS words
            FROM t LEFT JOIN g USING (text)
        ), l AS (
            SELECT doc_id, coalesce(max(CAST(quality = 1 AS INT)), 0) AS good, coalesce(max(CAST(toxic = 1 AS INT)), 0) AS toxic FROM labels GROUP BY doc_id
        ), m AS (
            SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, {
                'A': len(words) < 50,
                'B': 100 * len(list_distinct(words)) < 65 * len(words),
                'C': 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text),
                'D': regexp_matches(text, '[#$%&*|]'),
                'E': coalesce(copy, false)
            } AS f
            FROM w LEFT JOIN l USING (doc_id)
        ), d AS (
            SELECT part, concat(CASE WHEN f.A THEN 'A' ELSE '' END, CASE WHEN f.B THEN 'B' ELSE '' END, CASE WHEN f.C THEN 'C' ELSE '' END,
                                CASE WHEN f.D THEN 'D' ELSE '' END, CASE WHEN f.E THEN 'E' ELSE '' END) AS failed, good, toxic
            FROM m
        ), c AS (
            SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, failed
        ), o AS (
            SELECT '' AS filter_order UNION ALL
            SELECT filter_order || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x)
        ), s AS (
            SELECT filter_order, step, filter_order[step] AS x, filter_order[1:step - 1] AS earlier
            FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) WHERE len(filter_order) = 5
        ), r AS (
            SELECT part, filter_order, step, x,
                   sum(n) FILTER (translate(failed, earlier || x, '') = failed) AS kept,
                   coalesce(sum(n) FILTER (contains(failed, x) AND translate(failed, earlier, '') = failed), 0) AS removed,
                   coalesce(sum(n) FILTER (contains(failed, x) AND translate(failed, earlier, '') <> failed), 0) AS redundant,
                   coalesce(sum(n) FILTER (failed = x), 0) AS unique_fails,
                   coalesce(sum(good) FILTER (contains(failed, x) AND translate(failed, earlier, '') = failed), 0) AS good_lost,
                   coalesce(sum(toxic) FILTER (contains(failed, x) AND translate(failed, earlier, '') = failed), 0) AS toxic_lost
            FROM c, s GROUP BY ALL
        )
        SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
               CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
        FROM r""",
    "op13_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        ), u AS (
            SELECT vec_id, label, e, sqrt(list_sum([x * x FOR x IN e])) AS size FROM v
            WHERE label IS NOT NULL AND e IS NOT NULL AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0
        ), p AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.98
        ), r AS (
            SELECT a AS vec_id, b AS reached FROM p UNION SELECT r.vec_id, p.b FROM r JOIN p ON r.reached = p.a
        ), n AS (SELECT a AS vec_id, count(*) AS n_links FROM p GROUP BY a),
        c AS (SELECT vec_id, min(reached) AS least FROM r GROUP BY vec_id)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id,
               vec_id = least(vec_id, coalesce(least, vec_id)) AS kept
        FROM v LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)""",
}
